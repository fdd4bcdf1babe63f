"""Queries over the given tables; importing this package registers them."""

from granary.plans import budget, checks, customers, domain, extended, history, layouts, more, picks, rollups, rulebook, stock, streams, suites, weights  # noqa: F401
