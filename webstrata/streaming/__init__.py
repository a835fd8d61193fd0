"""webstrata.streaming"""
