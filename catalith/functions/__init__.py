"""catalith.functions"""
