"""Batch matching, price-benchmark and corpus analytics on Spark."""
