"""Knowledge-graph path analytics and training-data operators on Spark."""
