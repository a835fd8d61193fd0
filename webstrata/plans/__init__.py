"""webstrata.plans"""
