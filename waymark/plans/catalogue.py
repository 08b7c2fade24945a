"""All registered queries."""

from waymark.plans import (file_queries, mining_queries, rule_queries, score_queries, serving_queries, stream_queries,  # noqa: F401
                           text_queries, transform_queries)  # importing registers the queries
from waymark.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
