"""Imports every module of this subpackage that registers queries."""

import tidemark.llm.archive_queries  # noqa: F401
import tidemark.llm.mixture_queries  # noqa: F401
import tidemark.llm.table_queries  # noqa: F401
import tidemark.llm.text_queries  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES  # noqa: F401
