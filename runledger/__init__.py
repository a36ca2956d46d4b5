"""Benchmark workloads, experiment grids and job-log analytics as Spark DataFrame jobs."""
