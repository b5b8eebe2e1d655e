"""trendloom.streaming"""
