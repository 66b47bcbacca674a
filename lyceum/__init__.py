"""Course-knowledge analytics and corpus operators on Spark."""
