"""lumenbib.streaming"""
