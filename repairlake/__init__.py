"""Analytics over software-repair records and coding-agent traces on Spark."""
