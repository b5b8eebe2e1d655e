"""trendloom.sources"""
