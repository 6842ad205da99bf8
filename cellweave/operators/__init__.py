"""cellweave.operators"""
