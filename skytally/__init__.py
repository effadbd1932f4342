"""Flight-observation analytics on Spark."""
