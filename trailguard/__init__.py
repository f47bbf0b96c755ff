"""Detection and forensics over agent activity logs with Spark."""
