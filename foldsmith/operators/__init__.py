"""foldsmith.operators"""
