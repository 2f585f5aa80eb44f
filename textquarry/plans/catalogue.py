"""All queries of the library by name, with the SQL that states the result of each."""

from __future__ import annotations

from textquarry.plans import activity, chains, more, results, retrieval, rules, stored, texts

MODULES = (retrieval, texts, activity, results, more, chains, stored, rules)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
