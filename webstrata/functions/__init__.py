"""webstrata.functions"""
