"""promptlens.streaming"""
