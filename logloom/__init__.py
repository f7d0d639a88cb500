"""logloom: a Spark-first engine for event-log analytics."""
