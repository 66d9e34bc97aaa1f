"""Source-code dependency and risk analysis on Spark."""
