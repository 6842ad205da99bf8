"""cellweave.streaming"""
