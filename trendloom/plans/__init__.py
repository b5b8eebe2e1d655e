"""trendloom.plans"""
