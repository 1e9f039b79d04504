"""Imports every query module and exposes the registry."""

from shelfsight.plans import (  # noqa: F401
    content_queries, entity_queries, hint_queries, intent_queries, market_queries, source_queries,
    stream_queries, text_queries, usage_queries,
)
from shelfsight.plans.registry import ORACLES, QUERIES  # noqa: F401
