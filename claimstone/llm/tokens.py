"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays of symbol ids.  Each round looks up the ranks of
all neighbouring pairs, applies to each sequence its lowest-ranked pair (every occurrence
of it, left to right without overlap) at the same time for all sequences, and drops the
sequences that have none left; the surviving symbols are the tokens.

A long pre-token (base64, DNA, a line without a blank) takes many rounds.  Its rounds are
the same, but the places of each pair are kept by rank, so a round costs as much as it
changes and not the length of the pre-token.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from claimstone.sources.tables import table

#: Distinct pre-tokens a worker remembers before it starts over; bounds its memory.
REMEMBERED = 300_000
#: Symbols merged at a time.
CHUNK = 1 << 20
#: Bytes from which on a pre-token is merged by itself.
LONG = 512


class Vocabulary:
    """The merges of a tokenizer file, and counts of tokens by them."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, into = (np.array([ids[x] for x in xs], np.int64) for xs in (*zip(*pairs, strict=True), ["".join(p) for p in pairs]))
        self.wide = len(ids)
        keys = left * self.wide + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into[order]
        self.of_rank = (left, right, into)
        # A byte shows as itself where it prints, and the others as the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_ids = np.zeros(256, np.int64)
        for b, c in [*zip(shown, shown, strict=True), *((b, 256 + i) for i, b in enumerate(hidden))]:
            self.byte_ids[b] = ids[chr(c)]
        self.words = regex.compile(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), counts)
        totals = np.zeros(len(pieces), np.int64)
        none = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] * self.wide + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            found = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(found, self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            done = best == none
            totals[owner[starts[done]]] += sizes[done]
            hit = np.append(found & (rank == np.repeat(best, sizes)[:-1]), False)
            run = np.flatnonzero(hit)
            if len(run):  # in a run of overlapping occurrences (a a a) every other one holds
                new = np.concatenate(([True], np.diff(run) > 1))
                place = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
                run = run[place % 2 == 0]
                symbols[run] = self.into[at[run]]
                keep = np.repeat(~done, sizes)
                keep[run + 1] = False
            else:
                keep = np.repeat(~done, sizes)
            symbols, owner = symbols[keep], owner[keep]
        return totals

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges for those that don't merge."""
        pair = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys))

    def merged_long(self, piece: bytes) -> int:
        """The number of tokens of one long piece."""
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n, none = len(symbol), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: no neighbour
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Keeps the pairs that start at some places."""
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank < none], rank[rank < none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1, [len(rank)])) if len(rank) else [0]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[a:z])

        note(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(rank)))
            left, right, into = (int(x[rank]) for x in self.of_rank)
            at = at[alive[at] & (symbol[at] == left) & (after[at] < n)]
            at = at[symbol[after[at]] == right]
            if not len(at):
                continue
            if left == right:  # in a run of overlapping occurrences every other one holds
                new = np.concatenate(([True], after[at[:-1]] != at[1:]))
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 0]
            gone = after[at]
            symbol[at], alive[gone], after[at] = into, False, after[gone]
            follow = after[at]
            inside = follow < n
            before[follow[inside]] = at[inside]
            lead = before[at]
            changed = np.unique(np.concatenate((lead[lead >= 0], at[inside])))
            note(changed[after[changed] < n])
        return int(alive.sum())

    def learn(self, words: set[str]) -> None:
        """Counts the tokens of pre-tokens that aren't known."""
        long = [w for w in words if len(w) >= LONG]
        self.known.update((w, self.merged_long(w.encode())) for w in long)
        new = sorted(words.difference(long))
        while new:
            size, n = 0, 0
            while n < len(new) and (n == 0 or size + len(new[n]) * 4 <= CHUNK):
                size += len(new[n]) * 4
                n += 1
            batch, new = new[:n], new[n:]
            self.known.update(zip(batch, self.merged([w.encode() for w in batch]).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; a special string inside is one token."""
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            cut.append([w for part in parts for w in self.words.findall(part)])
            extra.append(len(parts) - 1)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*cut) - self.known.keys() if cut else set())
        known = self.known
        return [n + sum(map(known.__getitem__, words)) for n, words in zip(extra, cut, strict=True)]


@lru_cache(2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """Once for each worker.  Without a path, the public byte-level vocabulary of the machine."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a whole text; 0 for null."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        words = vocabulary(path)
        values = texts.tolist()
        out: list[int] = []
        for i in range(0, len(values), 200):
            out += words.counts(values[i : i + 200])
        return pd.Series(out, dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; a null text is empty, other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
