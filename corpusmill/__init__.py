"""Text-dataset analytics on Spark."""
