"""Share tables without sharing identities, and put the results back, on Spark."""
