"""Spark-first engine for 3-D image volumes and the point clouds found in them."""
