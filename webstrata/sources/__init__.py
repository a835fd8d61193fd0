"""webstrata.sources"""
