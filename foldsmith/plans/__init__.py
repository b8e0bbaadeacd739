"""foldsmith.plans"""
