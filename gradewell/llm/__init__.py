"""Operators for training-data pipelines over `documents`-like tables.

Every module is one operator: a general function over DataFrames, plus the thin
query the entry registers. `kernels` holds vectorised text helpers that run
inside Arrow batches, `common` the few Spark helpers they share.
"""
