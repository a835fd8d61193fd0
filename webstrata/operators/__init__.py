"""webstrata.operators"""
