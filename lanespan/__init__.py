"""lanespan: a Spark-first analytics engine for interval and event-sequence data."""
