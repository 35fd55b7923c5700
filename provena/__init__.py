"""Training-data exposure analytics and corpus preparation on Spark."""
