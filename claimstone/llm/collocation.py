"""Phrase collocation mining with broadcast double-array tries.

The corpus is read once into blocks: ragged arrays of word numbers with the words of the
block beside them.  A phrase can be frequent only if the phrases inside it are (Apriori).
So, length by length, the blocks add up hashes of the phrases whose first and last parts
may both be frequent; hashes that stay below the threshold rule their phrases out, and the
others are kept as bits of one array of fixed size.  Two phrases of one bit only add:
nothing frequent is lost.  Each hash that remains keeps one place, where its phrase is
read: these are the candidates.

Candidates go into double-array tries over words, at most ``SHARD`` in one (times a chance
excess of the hash that deals them), so that what is broadcast has a bound; each trie
passes over all blocks.  A trie moves all positions of a block at once, digit by digit of
a word's number: ``next = base[state] + digit``, held against ``check[next] = state``;
positions that fall out are dropped, and accepting states are counted by ``bincount``.  The
counts of all tasks, handed on as arrays, add up to the exact number of occurrences.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.llm.ragged import Numbers, numbered, slices
from claimstone.session import stored
from claimstone.sources.tables import table

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: A candidate goes if a longer one that holds it has so many percent of its occurrences.
INSIDE_PERCENT = 100
UNKNOWN = "und"
BLOCK_TOKENS, OPEN_TOKENS = 1 << 18, 1 << 22
#: Blocks of a row group and of an Arrow batch: a task holds so many in each of its steps.
TOGETHER = 8
#: Bits of the arrays that hold which hashes may be frequent: 2^26 are 8 MB, less where most are 0, since they travel compressed.
FILTER_BITS = 26
#: Bits of a place in a block, and of a block among those of a task.
PLACE_BITS, BLOCK_BITS = 20, 16
#: Attempts with another hash after two phrases shared one.
SEEDS = 8
#: Candidates of a trie.
SHARD = 200_000
#: Counts of a trie that go together in a row.
COUNTED = 1024
#: Hashes or words that a task gathers before it hands on their sums, and rows that it hands on at once.
HELD, ROWS = 1 << 20, 1 << 15
#: Candidates that are ranked together before the best of a language are.
RANKED_ROWS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(UPPER.encode() + b"\t" + _ENDS, LOWER.encode() + b" " + b"\n" * len(_ENDS))
_BLOCKS = "block long, lang string, words array<binary>, tokens array<int>, starts int"


class _Open:
    """The block of a language that is being filled; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang = lang
        self.begin([])

    def begin(self, before: list[bytes]) -> None:
        self.numbers = Numbers(first=-1)
        self.numbers |= {b"": -1, b"\n": 0}
        self.parts, self.size = [], 0
        self.add(before)

    def add(self, words: list[bytes]) -> None:
        found = numbered(words, self.numbers)
        found = found[found >= 0]
        self.parts.append(found)
        self.size += len(found)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The block.  But for the last one its final words are context: the next block starts with them."""
        tokens = np.concatenate(self.parts)
        context = 0 if last else min(len(tokens), LONGEST - 1)
        words = list(self.numbers)[2:]
        if len(tokens) > context:
            columns = [pa.array([self.lang]), pa.array([words], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens)), pa.array([len(tokens) - context], pa.int32())]
            yield pa.record_batch(columns, names=["lang", "words", "tokens", "starts"])
        self.begin([words[t - 1] if t else b"\n" for t in tokens[len(tokens) - context :].tolist()])


def _encode(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    blocks: dict[str, _Open] = {}
    first, made = TaskContext.get().partitionId() << BLOCK_BITS, 0

    def out(block: _Open, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        for rows in block.rows(last):
            if made >> BLOCK_BITS or rows["starts"][0].as_py() >> PLACE_BITS:
                raise ValueError("a task has too many blocks, or a block too many words")
            yield pa.RecordBatch.from_arrays([pa.array([first + made]), *rows.columns], ["block", *rows.schema.names])
            made += 1

    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            lang = lang.as_py()
            block = blocks.setdefault(lang, _Open(lang))
            for piece in slices(text.as_py()):
                block.add(piece.translate(_FOLD).replace(b"\n", b" \n ").split(b" "))
                if block.size >= block_tokens:
                    yield from out(block, last=False)
            block.add([b"\n"])
            if sum(b.size for b in blocks.values()) > OPEN_TOKENS:
                yield from out(blocks.pop(max(blocks, key=lambda x: blocks[x].size)), last=True)
    for block in blocks.values():
        yield from out(block, last=True)


def encoded(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """All texts as blocks ``block, lang, words, tokens, starts``; null languages are ``und``."""
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return named.mapInArrow(partial(_encode, block_tokens=block_tokens), _BLOCKS)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, tokens, starts = (batch[n][i] for n in ("lang", "words", "tokens", "starts"))
            yield lang.as_py(), words.values, tokens.values.to_numpy(), starts.as_py()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[pa.RecordBatch]:
        if held:
            sums = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
            yield from sums.to_batches(max_chunksize=ROWS)

    held: list[pa.Table] = []
    for lang, words, tokens, starts in _each(batches):
        n = np.bincount(tokens[:starts], minlength=len(words) + 1)[1:]
        some = np.flatnonzero(n)  # words of the context alone count in the next block
        held.append(pa.table({"lang": pa.array([lang] * len(some), pa.string()), "phrase": words.take(pa.array(some)), "n": pa.array(n[some])}))
        if sum(t.num_rows for t in held) >= HELD // 2:
            yield from out()
            held = []
    yield from out()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _word_hashes(lang: str, words: pa.Array, seed: int = 0) -> np.ndarray:
    """64 bits for each word, from its bytes and the language."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    size = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], size)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()) - 1, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
    sums = np.add.reduceat((raw + np.uint64(1)) * powers[place], offsets[:-1] - offsets[0])  # words aren't empty
    return _mixed(sums ^ np.uint64(xxhash.xxh64_intdigest(lang, seed)))


def _may(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    i = h & np.uint64((1 << FILTER_BITS) - 1)
    return bits[i >> np.uint64(6)] >> (i & np.uint64(63)) & np.uint64(1) > 0


def _phrases(lang: str, words: pa.Array, tokens: np.ndarray, starts: int, bits: list[np.ndarray], longest: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2: places and hashes of the phrases whose first and last parts pass their bits.

    bits: which hashes may be frequent, for lengths from 1.
    """
    of_word = _word_hashes(lang, words, seed)
    frequent = np.concatenate([[False], _may(of_word, bits[0])])
    of_word = np.concatenate([np.zeros(1, np.uint64), of_word])
    alive = frequent[tokens]
    at = np.flatnonzero(alive)
    h = of_word[tokens[at]]
    for k in range(2, longest + 1):
        follows = alive[np.minimum(at + 1, len(tokens) - 1)] & (at + k <= len(tokens))
        at = at[follows]
        h = h[follows] * np.uint64(0x9E3779B97F4A7C15) + of_word[tokens[at + k - 1]]
        mixed = _mixed(h)
        counted = at < starts
        yield k, at[counted], mixed[counted]
        if k <= len(bits):
            passed = _may(mixed, bits[k - 1])
            at, h = at[passed], h[passed]
            alive = np.zeros(len(tokens), bool)
            alive[at] = True


def _shared(spark: SparkSession, bits: np.ndarray) -> Broadcast:
    return spark.sparkContext.broadcast(zstandard.compress(bits.tobytes()))


def _opened(shared: list[Broadcast]) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(b.value), np.uint64) for b in shared]


def _hash_sums(batches: Iterator[pa.RecordBatch], shared: list[Broadcast], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the phrases of a length, how often each occurs, and one place of it."""
    def out() -> Iterator[pa.RecordBatch]:
        h, first, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_index=True, return_counts=True)
        place = np.concatenate([np.zeros(0, np.int64), *places])[first]
        for at in range(0, len(h), ROWS):
            part = slice(at, at + ROWS)
            yield pa.record_batch([pa.array(h[part].view(np.int64)), pa.array(n[part]), pa.array(place[part])], names=["h", "n", "place"])

    held, places = [], []
    bits = _opened(shared)
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch["block"][i].as_py() << PLACE_BITS
            for block in _each(iter([batch.slice(i, 1)])):
                for k, at, h in _phrases(*block, bits, length, seed):
                    if k == length:
                        held.append(h)
                        places.append(at + number)
            if sum(map(len, held)) >= HELD:
                yield from out()
                held, places = [], []
    yield from out()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases at the places that are asked for (``asked``: place, length, how often its hash occurs)."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, tokens, asked = (batch[n][i] for n in ("lang", "words", "tokens", "asked"))
            text, ids = words.values, tokens.values.to_numpy()
            place, size, n = (asked.values.field(k).to_numpy() for k in range(3))
            found = [b" ".join([text[t - 1].as_py() for t in ids[a : a + k].tolist()]) for a, k in zip(place.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(n)], names=["lang", "phrase", "n"])


class DoubleArray:
    """A trie of phrases, one root for each language; a state is a place in the arrays.

    A word is a number, written in ``digits`` digits of base 256, so that the children of
    a state lie within 256 places.  The place of the child of s for digit d is
    ``base[s] + d``, if ``check`` there is s.  ``accept`` has the number of the phrase that
    ends in a state, or -1.  The first and last place stay free, so that places outside can
    be read as these.
    """

    def __init__(self, phrases: list[tuple[str, bytes]]):
        cut = [p.split(b" ") for _, p in phrases]
        self.n, self.depth = len(phrases), max(map(len, cut), default=0)
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for p in cut for w in p}))}
        self.digits = max(1, -(-len(self.words).bit_length() // 8))
        self.roots = {lang: i + 1 for i, lang in enumerate(sorted({lang for lang, _ in phrases}))}
        size = np.array([len(p) for p in cut], np.int64)
        word = np.zeros((self.n, self.depth), np.int64)
        for i, p in enumerate(cut):
            word[i, : len(p)] = [self.words[w] for w in p]
        # Nodes: the roots, then the prefixes of one digit, of two, ...
        node = np.array([self.roots[lang] - 1 for lang, _ in phrases], np.int64)
        none = np.zeros(0, np.int64)
        parents, labels, ends, nodes = [none], [none], [], len(self.roots)
        for k in range(self.depth):
            rows = np.flatnonzero(size > k)
            for digit in self._digits(word[rows, k]):
                key, place = np.unique(node[rows] << 8 | digit, return_inverse=True)
                parents.append(key >> 8)
                labels.append(key & 255)
                node[rows] = nodes + place
                nodes += len(key)
            done = rows[size[rows] == k + 1]
            ends.append((node[done], done))
        parent = np.concatenate(parents)
        place, base = self._placed(len(self.roots), nodes, parent, np.concatenate(labels))
        length = int(place.max(initial=0)) + 2
        self.base, self.check, self.accept = np.zeros(length, np.int32), np.full(length, -1, np.int32), np.full(length, -1, np.int32)
        self.base[place] = base
        self.check[place[len(self.roots) :]] = place[parent]
        for states, numbers in ends:
            self.accept[place[states]] = numbers

    def _digits(self, word: np.ndarray) -> Iterator[np.ndarray]:
        for i in reversed(range(self.digits)):
            yield word >> 8 * i & 255

    @staticmethod
    def _placed(roots: int, nodes: int, parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and bases of all nodes: those of many children first, then those of one into what is free."""
        place, base = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        place[:roots] = np.arange(1, roots + 1)
        order = np.argsort(parent, kind="stable")
        first = np.flatnonzero(np.diff(parent[order], prepend=-1))
        count = np.diff(np.append(first, len(order)))
        used = np.zeros(2 * nodes + 1024, bool)
        used[: roots + 1] = True
        low, top = roots + 1, roots + 1
        for g in np.argsort(-count, kind="stable").tolist():
            if count[g] == 1:
                break
            children = order[first[g] : first[g] + count[g]]
            labels = label[children]
            free = low + np.flatnonzero(~used[low : low + 128])
            fits = ~used[free[:, None] - labels[0] + labels].any(axis=1)
            at = int(free[fits.argmax()] if fits.any() else max(top, low + 128)) - int(labels[0])
            used[at + labels] = True
            top = max(top, at + int(labels[-1]) + 1)
            if top + 1024 > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            base[parent[children[0]]] = at
            place[roots + children] = at + labels
            if len(free) < 48:
                low += 64
        single = order[first[count == 1]]
        free = np.flatnonzero(~used)
        if len(free) < len(single):
            free = np.concatenate([free, len(used) + np.arange(len(single))])
        base[parent[single]] = free[: len(single)] - label[single]
        place[roots + single] = free[: len(single)]
        return place, base

    def count(self, lang: str, words: list[bytes], tokens: np.ndarray, starts: int, counts: np.ndarray) -> None:
        """Add the occurrences of all phrases of a language in a block to ``counts``."""
        if lang not in self.roots:
            return
        known = np.array([0, *(self.words.get(w, 0) for w in words)], np.int32)
        text = np.concatenate([known[tokens], np.zeros(self.depth, np.int32)])
        at = np.flatnonzero(text[:starts])
        state = np.full(len(at), self.roots[lang])
        for k in range(self.depth):
            word = text[at + k]
            here = word > 0
            at, state, word = at[here], state[here], word[here]
            for i in reversed(range(self.digits)):
                to = np.clip(self.base[state] + (word >> 8 * i & 255), 0, len(self.base) - 1)
                moved = self.check[to] == state
                at, state, word = at[moved], to[moved], word[moved]
            ends = self.accept[state]
            counts += np.bincount(ends[ends >= 0], minlength=self.n)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    trie = zstandard.compress(pickle.dumps(DoubleArray([row[1:] for row in sorted(rows)])))
    yield pa.record_batch([pa.array([trie], pa.binary())], names=["trie"])


def _trie_counts(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    trie = pickle.loads(zstandard.decompress(shared.value))
    counts = np.zeros(trie.n, np.int64)
    for lang, words, tokens, starts in _each(batches):
        trie.count(lang, words.to_pylist(), tokens, starts, counts)
    for part, at in enumerate(range(0, trie.n, COUNTED)):
        own = counts[at : at + COUNTED]
        yield pa.record_batch([pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], names=["part", "counts"])


def _added(parts: pa.Table) -> pa.Table:
    """The sums of one part of the counts over all tasks."""
    sums = np.sum([c.values.to_numpy() for c in parts["counts"]], axis=0)
    some = np.flatnonzero(sums)
    return pa.table({"no": pa.array(parts["part"][0].as_py() * COUNTED + some), "a": pa.array(sums[some])})


def _hashed(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = batch.columns
        for lang in langs.unique().to_pylist():
            own = words.filter(pc.equal(langs, lang))
            yield pa.record_batch([pa.array(_word_hashes(lang, own, seed).view(np.int64))], names=["h"])


def _bits(hashes: DataFrame) -> np.ndarray:
    """The array of bits of some hashes; it has the same size however many there are."""
    i = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)).cast("int"))
    held = hashes.groupBy(F.shiftright(i, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return out


def _candidates(blocks: DataFrame, words: DataFrame, min_count: int, longest: int, seed: int) -> DataFrame:
    """``lang, phrase, n``: a phrase for each hash that occurs ``min_count`` times or more, and how often it does."""
    spark = blocks.sparkSession
    shared = [_shared(spark, _bits(words.where(F.col("a") >= min_count).select("lang", "phrase").mapInArrow(partial(_hashed, seed=seed), "h long")))]
    places = None
    for k in range(2, longest + 1):
        sums = blocks.mapInArrow(partial(_hash_sums, shared=shared, length=k, seed=seed), "h long, n long, place long").groupBy("h").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
        often = stored(sums.where(F.col("n") >= min_count), "frequent-hashes", batch=TOGETHER)
        shared = [*shared, _shared(spark, _bits(often))]
        own = often.select(F.lit(k).cast("long").alias("k"), "n", "place")
        places = own if places is None else places.unionByName(own)
    for bits in shared:
        bits.unpersist()
    at = F.struct(F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"), "k", "n")
    asked = places.groupBy(F.shiftright("place", PLACE_BITS).alias("block")).agg(F.collect_list(at).alias("asked"))
    return stored(blocks.join(asked, "block").select("lang", "words", "tokens", "asked").mapInArrow(_names, "lang string, phrase binary, n long"), "candidates", batch=TOGETHER)


def frequent(blocks: DataFrame, words: DataFrame, *, min_count: int, longest: int, shard: int) -> DataFrame:
    """``lang, phrase, a``: the phrases of two to ``longest`` words with ``min_count`` occurrences or more, exactly counted.

    A hash names one phrase.  If that phrase occurs less often than its hash, another one
    has the same hash, and all is done again with other hashes.
    """
    spark = blocks.sparkSession
    for seed in range(SEEDS):
        found = _candidates(blocks, words, min_count, longest, seed)
        shards = -(-found.count() // shard)
        if not shards:
            return found.select("lang", "phrase", F.col("n").alias("a"))
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)))
        dealt = stored(dealt.withColumn("no", F.row_number().over(Window.partitionBy("shard").orderBy("lang", "phrase")).cast("long") - 1), "dealt")
        counts = None
        for s in range(shards):
            built = dealt.where(F.col("shard") == s).select("no", "lang", "phrase").coalesce(1).mapInArrow(_built, "trie binary").first()
            trie = spark.sparkContext.broadcast(bytes(built.trie))
            own = blocks.mapInArrow(partial(_trie_counts, shared=trie), "part long, counts array<long>").groupBy("part").applyInArrow(_added, "no long, a long")
            own = stored(own.withColumn("shard", F.lit(s).cast("long")), "trie-counts", batch=TOGETHER)
            trie.unpersist()
            counts = own if counts is None else counts.unionByName(own)
        counted = stored(dealt.join(counts, ["shard", "no"], "left"), "counted")
        if counted.where("a is null or a <> n").isEmpty():
            return counted.select("lang", "phrase", "a")
    raise RuntimeError("phrases share hashes again and again")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, top: int = TOP,
    block_tokens: int = BLOCK_TOKENS, shard: int = SHARD, ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    A phrase is scored by its weakest cut into two parts, 1000 a n / (l r) rounded down,
    and goes if a longer candidate holds it in ``inside_percent`` of its occurrences or
    more.  Every row is a document, also where ids repeat; null texts are empty; null
    languages are ``und``; other columns are ignored; an empty table gives no row.  Counts
    are exact below 10^16.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    blocks = stored(encoded(docs, text_col=text_col, lang_col=lang_col, block_tokens=block_tokens), "blocks", group=TOGETHER)
    words = stored(blocks.mapInArrow(_word_counts, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a")), "words", batch=TOGETHER)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = frequent(blocks, words, min_count=min_count, longest=longest, shard=shard).withColumn("phrase", F.col("phrase").cast("string"))
    phrases = stored(found.withColumn("w", F.split("phrase", " ")), "phrases")
    counts = words.where(F.col("a") >= min_count).select("lang", F.col("phrase").cast("string").alias("phrase"), "a").unionByName(phrases.select("lang", "phrase", "a"))
    size = F.size("w")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, size - F.col("k")), " ").alias("right"))
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in "alrn"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"]), wide["l"] * wide["r"])
    scored = parts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Occurrences don't grow with length, so the longer candidates of one more word decide.
    shorter = F.array(F.array_join(F.slice("w", 1, size - 1), " "), F.array_join(F.slice("w", 2, size - 1), " "))
    longer = phrases.where(size > 2).select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("inside") < inside_percent * F.col("a"), F.lit(True)))
    left = stored(left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salts = max(1, left.count() // ranked_rows)
    best = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
SQL = {
    "op13_phrase_collocations": rf"""
        WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, range(1, {LONGEST + 1}) t(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
        n AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, n.n, x.k, l.a AS l, r.a AS r, 1000::HUGEINT * c.a * n.n // (l.a::HUGEINT * r.a) AS score
            FROM c JOIN n USING (lang) JOIN range(1, {LONGEST}) x(k) ON x.k < c.k
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:x.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.k + 1:], ' ')),
        cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        parts AS (SELECT c.lang, c.a, array_to_string(c.w[s:s + m - 1], ' ') AS phrase FROM c, range(2, {LONGEST}) t(m), range(1, {LONGEST}) u(s) WHERE m < c.k AND s + m - 1 <= c.k),
        inside AS (SELECT lang, phrase, max(a) AS inside FROM parts GROUP BY ALL),
        ranked AS (SELECT cut.*, row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM cut LEFT JOIN inside USING (lang, phrase) WHERE inside IS NULL OR 100 * inside < {INSIDE_PERCENT} * a)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}""",
}
