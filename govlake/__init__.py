"""Governance analytics for AI usage logs, written as Spark DataFrame jobs.

Every operator takes and returns DataFrames or Columns; see the sub-packages:

* ``functions``  Column expressions (parsing, pricing, redaction, templates)
* ``operators``  DataFrame operators (rollups, budgets, limits, gates, prompts)
* ``sources``    table readers, table sinks and the derived sample views
* ``plans``      composed jobs and the catalogue of runnable queries
* ``streaming``  the same rules on Structured Streaming sources
"""

import sys

from pyspark import cloudpickle

from govlake.policy import Policy, RateWindow

# Functions that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Policy", "RateWindow"]
