"""promptlens.functions"""
