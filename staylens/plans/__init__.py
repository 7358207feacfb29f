"""Query families of the market library; importing this package registers them."""

from staylens.plans import comps, intake, market, offers, pricing, runs, series, signals, sites, stays, texts
from staylens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "comps", "intake", "market", "offers", "pricing", "runs", "series", "signals", "sites", "stays", "texts"]
