"""Activity analytics on Spark: time-series operators for dense behavioural recordings."""
