"""cellweave.plans"""
