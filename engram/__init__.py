"""Analytics for long-term agent memory, on PySpark."""
