"""lumenbib.sources"""
