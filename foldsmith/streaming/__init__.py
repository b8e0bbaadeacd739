"""foldsmith.streaming"""
