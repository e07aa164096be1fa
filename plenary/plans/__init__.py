"""Query plans by subject. Each module has PLANS: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from . import cases, events, governance, graph, meetings, quality, replication, text, votes

CATALOGUE = {k: v for m in (votes, meetings, text, graph, quality, replication, events, cases, governance) for k, v in m.PLANS.items()}
