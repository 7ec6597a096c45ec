"""Spark operators for finding anomalies in industrial-control packet sequences."""
