"""catalith.operators"""
