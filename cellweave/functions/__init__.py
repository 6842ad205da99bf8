"""cellweave.functions"""
