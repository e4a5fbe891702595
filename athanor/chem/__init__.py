"""Molecular kernels in plain Python: no Spark here, one molecule at a time."""
