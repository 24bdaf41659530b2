"""Packed customer orders to pick sheets, as Spark DataFrame jobs."""
