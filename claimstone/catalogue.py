"""Every registered query of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimstone.functions import criteria, facts, spoken_evidence, text, transcripts
from claimstone.operators import chunking, intervals, jobs, matching, packing, publication, retrieval, similarity, store, substrings
from claimstone.plans import canonical, gate, requirements, scoring
from claimstone.sources import audio, files, payloads
from claimstone.streaming import events

MODULES = (files, text, transcripts, facts, spoken_evidence, criteria, chunking, retrieval, similarity, intervals, matching, jobs, publication, requirements, canonical, gate, scoring, store, packing, substrings, audio, payloads, events)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.SQL.items()}
