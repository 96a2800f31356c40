"""promptlens.sources"""
