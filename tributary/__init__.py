"""tributary: event-log analytics and corpus preparation on Spark."""
