"""cellweave.sources"""
