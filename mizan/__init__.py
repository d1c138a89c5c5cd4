"""Analytics of regulatory documents and periodic indicators on Spark."""
