"""All registered queries; importing a module registers its queries."""

from lapstream.plans import (  # noqa: F401
    queries_backtest,
    queries_board,
    queries_clean,
    queries_feed,
    queries_history,
    queries_outcomes,
    queries_pace,
    queries_sources,
    queries_streaming,
)
from lapstream.plans.registry import ORACLES, QUERIES  # noqa: F401
