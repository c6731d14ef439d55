"""Evidence auditing and corpus preparation on Spark."""
