"""Order analytics on Spark: typed landing, quality rules, marts and live orders."""
