"""trendloom.functions"""
