"""tidemark: change detection, signal ranking and delivery accounting as Spark DataFrame jobs.

Every public operator takes DataFrames and returns DataFrames; all accounts and
all dates are handled by the same plan, keyed by ``account_id``.
"""

__version__ = "0.1.0"
