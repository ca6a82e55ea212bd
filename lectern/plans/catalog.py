"""All registered queries."""

from lectern.plans import (  # noqa: F401
    cache_queries,
    ledger_queries,
    markup_queries,
    recovery_queries,
    stream_queries,
    text_queries,
)
from lectern.plans.registry import ORACLES, QUERIES  # noqa: F401
