"""Data-preparation jobs as ordinary Spark DataFrame plans."""
