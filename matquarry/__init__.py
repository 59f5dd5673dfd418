"""Materials evidence analytics on Spark."""
