"""Batch analytics for retail order data, written as PySpark DataFrame jobs."""
