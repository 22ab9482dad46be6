"""catalith.streaming"""
