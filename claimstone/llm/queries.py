"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from claimstone.llm import collocation, contamination, divergence, language, media, mixing, quality, quality_rules, simhash, suffix, tokens, toxicity, warc

MODULES = (warc, simhash, media, quality, contamination, tokens, toxicity, mixing, language, suffix, divergence, quality_rules, collocation)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
