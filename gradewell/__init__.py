"""gradewell — score free-text code answers with Spark DataFrame jobs.

Layers:
  sources/    scans (JSONL tasks, driver parquet tables, derived corpus) and sinks
  functions/  Column -> Column helpers (text, regex, math) that stay JVM-side
  operators/  extraction, language detection, metrics, fact tables, joins, windows
  plans/      one plan per score dimension plus the cross-dimension scorecard
  streaming/  the same stateless plans under Structured Streaming
"""

import sys

from pyspark import cloudpickle

from gradewell.session import get_session, checkpoint_dir

# Functions of this package travel to Python workers by value, so executors
# need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
