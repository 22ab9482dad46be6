"""catalith.plans"""
