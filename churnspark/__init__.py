"""Customer-churn analytics as set-at-a-time Spark jobs."""
