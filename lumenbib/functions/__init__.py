"""lumenbib.functions"""
