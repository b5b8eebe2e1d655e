"""trendloom.operators"""
