"""promptlens.operators"""
