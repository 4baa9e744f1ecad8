"""Imports every module that registers queries."""

import workload.usage_queries  # noqa: F401
import workload.ranking_queries  # noqa: F401
import workload.change_queries  # noqa: F401
import workload.state_queries  # noqa: F401
import workload.run_queries  # noqa: F401
import workload.gate_queries  # noqa: F401
import workload.news_queries  # noqa: F401
import workload.schedule_queries  # noqa: F401
import workload.stream_queries  # noqa: F401
