"""Search and evaluation of small, readable scoring models over wide sparse tables, on Spark."""
