"""lumenbib.plans"""
