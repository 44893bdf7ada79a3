"""Query catalogue over the warehouse tables."""

from __future__ import annotations


def catalogue():
    """All registered queries, by name."""
    from barloom.plans import (  # noqa: F401
        evaluations,
        portfolios,
        runlogs,
        signals,
        windows,
    )
    from barloom.plans.registry import CATALOGUE

    return dict(sorted(CATALOGUE.items()))
