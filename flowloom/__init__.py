"""Flowloom: process-text analytics and training-data operators as Spark jobs."""
