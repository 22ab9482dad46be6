"""catalith.sources"""
