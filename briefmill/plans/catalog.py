"""All registered queries."""

from briefmill.plans import (  # noqa: F401
    debate_queries, finding_queries, graph_queries, hitl_queries, search_queries, stream_queries, table_queries, text_queries, verdict_queries,
)
from briefmill.plans.registry import ORACLE, QUERIES  # noqa: F401
