"""foldsmith.functions"""
