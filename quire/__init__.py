"""Case-file analytics and corpus preparation on Spark."""
