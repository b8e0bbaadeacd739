"""foldsmith.sources"""
