"""trendloom: a PySpark-native analytics engine for emerging-trend evidence."""
