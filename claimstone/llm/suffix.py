"""Exact removal of long repeated substrings by threshold-bounded suffix intervals.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id.  The strings of all documents are compared exactly:

1. *Copies.*  Of equal texts only the one with the smallest id goes on; the others are
   covered whole.  The texts that go on are written in packs of some ``PACK`` bytes.
2. *Anchors.*  A string's anchor is the smallest hash of its runs of ``GRAM`` bytes, so
   equal strings have equal anchors.  Neighbouring strings mostly share theirs; a maximal
   run of such strings is a segment.  Only anchors that more than one document has can
   belong to a repeated string.  Each pack tells each anchor once, with the number of its
   documents, so an anchor that all documents have brings a row for each pack.
3. *Segments* of such anchors go, with their bytes, to the group of their anchor.  Equal
   segments are settled by their smallest document, first inside packs.
4. *Intervals.*  The different segments of some groups make one text.  Breadth-first
   backward extension on its Burrows-Wheeler transform derives the common prefixes of
   neighbouring suffixes by increasing value and stops at LENGTH: suffixes between which no
   value was derived share LENGTH bytes, and the smallest document among them decides.
   Segments none of whose strings has its hash in another one stay out of the text.

The group of an anchor in more than ``CROWD`` documents is salted: its strings are segments
of their own there, dealt by their own hash, and are compared as in steps 3 and 4.

Between tasks travel arrays, one for each pack and bucket of anchors, not rows for anchors.
The number of buckets grows with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimstone.session import stored
from claimstone.sources.tables import table

LENGTH = 50
GRAM = 24
CROWD = 20_000
#: Bytes whose hashes are computed at a time, strings in one segment at most, and bytes of one text in step 4 (whole groups).
PIECE, RUN, TEXT = 1 << 16, 1024, 1 << 19
#: Bytes of texts in a pack, and for each bucket.
PACK, BUCKET = 1 << 23, 1 << 23
#: Stands for a missing id; it is larger than all others, and an id of this value counts as missing.
NO_ID = (1 << 63) - 1

BODY = np.dtype([("key", "<u8"), ("id", "<i8"), ("doc", "<u4"), ("start", "<u4"), ("size", "<u4")])
SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes: polynomial, by doubling, then mixed."""
    base = 0x100000001B3
    power, width = data.astype(np.uint64) + np.uint64(1), 1  # hashes of runs of `width`
    done, held = None, 0
    left = size
    while True:
        if left & 1:
            if done is None:
                done, held = power, width
            else:  # a run of held bytes, then one of width bytes
                n = len(done) - width
                done = done[:n] * np.uint64(pow(base, width, 1 << 64)) + power[held : held + n]
                held += width
        left >>= 1
        if not left:
            return _mixed(done.copy())
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2


def _window_minima(h: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (size - width)], h[size - width :]) if size > width else h


def segments(texts: list[bytes], length: int = LENGTH, gram: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of some texts: number of the text, first string, number of strings, anchor."""
    gram = GRAM if gram is None else gram
    found: list[list[np.ndarray]] = [[], [], [], []]
    batch: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        sizes = np.array([len(b) for _, _, b in batch])
        data = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
        minima = _window_minima(_run_hashes(data, gram), length - gram + 1)
        ends = np.cumsum(sizes)
        first, valid = ends - sizes, np.zeros(len(data) + 1, np.int8)
        np.add.at(valid, first, 1)
        np.add.at(valid, ends - length + 1, -1)
        inside = np.cumsum(valid)[: len(minima)] > 0
        same = np.concatenate(([False], (minima[1:] == minima[:-1]) & inside[1:] & inside[:-1]))
        stops = np.append(np.flatnonzero(~same | ~inside), len(minima))
        starts = np.flatnonzero(inside & ~same)
        counts = stops[np.searchsorted(stops, starts, "right")] - starts
        place = np.searchsorted(ends, starts, "right")
        number, offset = (np.array([b[k] for b in batch]) for k in (0, 1))
        for out, values in zip(found, (number[place], starts - first[place] + offset[place], counts, _mixed(minima[starts])), strict=True):
            out.append(values)
        batch.clear()

    room = PIECE
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            if batch and len(piece) > room:
                flush()
                room = PIECE
            batch.append((i, at, piece))
            room -= len(piece)
    if batch:
        flush()
    if not found[0]:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in found)  # type: ignore[return-value]


def shared_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols 0 to 256) in order of their first ``length`` symbols or more, and the numbers of their groups.

    Two suffixes are in a group if their first ``length`` symbols are equal.
    """
    n = len(text) + 1
    text = np.append(text.astype(np.int64) + 1, 0)  # ends with a symbol smaller than all others
    padded = np.concatenate([text, np.zeros(7, np.int64)])
    key, width = np.zeros(n, np.int64), 7
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    while True:  # prefixes of prefixes; ranks of equal prefixes are equal
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        if width >= length:
            break
        key, times = rank, 3 if n < 1 << 20 else 2  # so many ranks fit a key
        for k in range(1, times):
            later = np.zeros(n, np.int64)
            later[: max(n - k * width, 0)] = rank[k * width :] + 1
            key = key * (n + 1) + later
        width *= times
    # The transform: the symbol before each suffix, the end symbol before the first.  Sorted
    # by it, rank k's suffix is that symbol in front of the suffix with rank source[k].
    before = text[order - 1].astype(np.uint16)
    source = np.argsort(before, kind="stable")
    symbol = before[source]
    # Where the first symbol differs the common prefix is 0.
    starts = np.concatenate(([True], symbol[1:] != symbol[:-1]))
    derived = starts.copy()
    waiting = np.flatnonzero(~starts)
    low, high = source[waiting - 1], source[waiting]
    fresh = starts
    for _ in range(1, length):
        # Extending the intervals of the last round by a symbol: a boundary between two
        # suffixes is one between their extensions by the same symbol, one longer.
        passed = np.cumsum(fresh, dtype=np.int32)
        hit = passed[high] > passed[low]
        fresh = np.zeros(n, bool)
        fresh[waiting[hit]] = True
        derived |= fresh
        if not hit.any():
            break
        if 8 * np.count_nonzero(hit) > len(hit):  # one that stays is derived again, after those that it extends to
            waiting, low, high = waiting[~hit], low[~hit], high[~hit]
    return order[1:], np.cumsum(derived)[1:] - 2


def covered(bodies: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each body the ranges of bytes whose strings of ``length`` also are in a body with a smaller id."""
    sizes = np.array([len(b) + 1 for b in bodies])
    text = np.full(sizes.sum(), 256, np.int64)
    at = np.cumsum(sizes) - sizes
    inside = np.ones(len(text), bool)
    inside[at + sizes - 1] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    string = np.arange(len(text)) - at[owner] <= sizes[owner] - 1 - length
    order, group = shared_prefix_groups(text, length)
    id_at = np.where(string, ids[owner], NO_ID)[order]
    least = np.minimum.reduceat(id_at, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    flag = np.zeros(len(text) + 1, bool)
    flag[order] = (least[group] < id_at) & string[order]
    edge = np.diff(flag.astype(np.int8), prepend=0)
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    # A separator never starts a string, so no run of flags goes from one body to the next.
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        o = owner[a]
        out[o].append((a - int(at[o]), b - int(at[o]) + length - 1))
    return out


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, m1, m2, text) as packs: their columns as arrays, the texts one after the other, compressed."""
    compress = zstandard.ZstdCompressor(level=1).compress
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    done, size = 0, 0
    held: list[tuple[int, int, int, bytes]] = []
    seen: set[tuple[int, int, int]] = set()  # rows that repeat an id and a text come to one task

    def pack() -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        ids, m1, m2 = (np.array([r[k] for r in held], np.int64).tobytes() for k in range(3))
        sizes = np.array([len(r[3]) for r in held], np.uint32).tobytes()
        row = {"pack": [base + done], "ids": [ids], "m1": [m1], "m2": [m2], "sizes": [sizes], "data": [compress(b"".join(r[3] for r in held))]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("pack", pa.int64()), *((n, pa.binary()) for n in ("ids", "m1", "m2", "sizes", "data"))]))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            if row[:3] in seen:
                continue
            seen.add(row[:3])
            held.append(row)
            size += len(row[3])
            if size >= PACK:
                yield pack()
                done, size = done + 1, 0
                held.clear()
    if held:
        yield pack()


def _opened(row: dict) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Ids of a pack's documents, their texts in one, and where each begins (and the last one ends)."""
    sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), zstandard.ZstdDecompressor().decompress(row["data"]), np.concatenate(([0], np.cumsum(sizes)))


def _pack_segments(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return segments([data[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def _dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets, by the first ``bits`` bits, of sorted keys, with their slices."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, z)


BLOB = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("blob", pa.binary())])
BLOB_SQL = "bucket long, pack long, blob binary"
LOCAL = -1  # the bucket of what is settled inside packs


def _blobs(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOB in batches of some MB."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= 1 << 23 or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), BLOB, strict=True)], schema=BLOB)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), BLOB, strict=True)], schema=BLOB)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _anchors(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each pack and bucket its different anchors and in how many documents each is."""

    def told(row: dict) -> Iterator[tuple[int, int, bytes]]:
        _, data, at = _opened(row)
        owner, _, _, anchor = _pack_segments(data, at)
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        fresh = np.concatenate((np.ones(min(len(anchor), 1), bool), (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
        anchor = anchor[fresh]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(anchor), 1), bool), anchor[1:] != anchor[:-1])))
        docs = np.diff(np.append(first, len(anchor))).astype(np.uint32)
        anchor = anchor[first]
        for bucket, part in _dealt(anchor, bits):
            yield bucket, row["pack"], anchor[part].tobytes() + docs[part].tobytes()

    return lambda batches: _blobs(out for row in _rows(batches) for out in told(row))


def _repeated(group: pa.Table) -> pa.Table:
    """Of a bucket's anchors those in more than one document, for each pack that has them, with whether they are crowded."""
    packs, blobs = group.column("pack").to_pylist(), group.column("blob").to_pylist()
    anchors, docs = [], []
    for b in blobs:
        n = len(b) // 12
        anchors.append(np.frombuffer(b, np.uint64, n))
        docs.append(np.frombuffer(b, np.uint32, n, 8 * n))
    names, place = np.unique(np.concatenate(anchors), return_inverse=True)
    total = np.bincount(place, np.concatenate(docs))
    out: dict[str, list] = {"pack": [], "blob": []}
    at = 0
    for pack, own in zip(packs, anchors, strict=True):
        n = total[place[at : at + len(own)]]
        at += len(own)
        use = n > 1
        if use.any():
            out["pack"].append(pack)
            out["blob"].append(own[use].tobytes() + (n[use] > CROWD).tobytes())
    return pa.table(out, schema=pa.schema([("pack", pa.int64()), ("blob", pa.binary())]))


def _bodies(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bodies to compare, for each pack and bucket: the segments of repeated anchors, in runs of at most RUN strings; of crowded anchors every single string.

    Of equal bodies in a pack those of larger documents are covered, and come as spans.
    """

    def told(row: dict) -> Iterator[tuple[int, int, bytes]]:
        ids, data, at = _opened(row)
        parts = row["blobs"]
        sizes = [len(b) // 9 for b in parts]
        known = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(parts, sizes, strict=True)])
        crowd = np.concatenate([np.frombuffer(b, bool, n, 8 * n) for b, n in zip(parts, sizes, strict=True)])
        order = np.argsort(known)
        known, crowd = known[order], crowd[order]
        owner, start, count, anchor = _pack_segments(data, at)
        place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        use = known[place] == anchor
        owner, start, count, anchor, single = owner[use], start[use], count[use], anchor[use], crowd[place[use]]
        runs = -(-count // RUN)  # long segments in runs
        if (runs > 1).any():
            k = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            owner, anchor, single = (np.repeat(x, runs) for x in (owner, anchor, single))
            start, count = np.repeat(start, runs) + k * RUN, np.minimum(np.repeat(count, runs) - k * RUN, RUN)
        size = count + LENGTH - 1
        begin = at[owner] + start
        bodies = [data[a:z] for a, z in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        docs = ids[owner]
        seen: dict[bytes, int] = {}  # documents come by id, so the first one with a body is its smallest
        least = np.fromiter(map(seen.setdefault, bodies, docs.tolist()), np.int64, len(bodies))
        whole = least < docs
        gone = [np.rec.fromarrays([owner[whole], start[whole], (start + size)[whole]], SPAN)]
        keep = np.flatnonzero(~whole & ~single)
        key, kept = anchor[keep], [bodies[i] for i in keep.tolist()]
        where, first = owner[keep], start[keep]
        salted = np.flatnonzero(~whole & single)
        if len(salted):  # a crowded anchor's strings, one by one
            n = count[salted]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where2, first2 = np.repeat(owner[salted], n), np.repeat(start[salted], n) + k
            strings = [data[a : a + LENGTH] for a in (at[where2] + first2).tolist()]
            least = np.fromiter(map(seen.setdefault, strings, ids[where2].tolist()), np.int64, len(strings))
            whole = least < ids[where2]
            gone.append(np.rec.fromarrays([where2[whole], first2[whole], first2[whole] + LENGTH], SPAN))
            left = np.flatnonzero(~whole)
            strings = [strings[i] for i in left.tolist()]
            named = np.fromiter((int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big") for b in strings), np.uint64, len(strings))
            key, kept = np.concatenate((key, named)), kept + strings
            where, first = np.concatenate((where, where2[left])), np.concatenate((first, first2[left]))
        order = np.argsort(key, kind="stable")
        rows = np.rec.fromarrays([key, ids[where], where, first, np.fromiter(map(len, kept), np.uint32, len(kept))], BODY)[order]
        kept = [kept[i] for i in order.tolist()]
        for bucket, part in _dealt(key[order], bits):
            yield bucket, row["pack"], len(rows[part]).to_bytes(4, "little") + rows[part].tobytes() + b"".join(kept[part])
        spans = joined_spans(np.concatenate(gone))
        if len(spans):
            yield LOCAL, row["pack"], spans.tobytes()

    return lambda batches: _blobs(out for row in _rows(batches) for out in told(row))


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans with those of a document that touch made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    doc = spans["doc"].astype(np.int64) << 32
    reach = np.maximum.accumulate(doc + spans["end"])
    new = np.concatenate(([True], (doc + spans["start"])[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["end"] = (reach[np.append(first[1:], len(spans)) - 1] - doc[first]).astype(np.uint32)
    return out


def _with_company(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bodies have strings of ``length`` bytes whose hash other places have too, and from where to where these strings go."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(sizes)
    hashes = _run_hashes(np.frombuffer(b"".join(bodies), np.uint8), length)
    owner = np.repeat(np.arange(len(bodies)), sizes)[: len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) + length <= ends[owner])
    short = (hashes[inside] >> np.uint64(64 - max(8, 2 + len(inside).bit_length()))).astype(np.int64)
    place = inside[np.bincount(short)[short] > 1]
    which, first = np.unique(owner[place], return_index=True)
    last = np.append(first[1:], len(place)) - 1
    begin = (ends - sizes)[which]
    return which, place[first] - begin, place[last[: len(which)]] - begin + length


def _settled(group: pa.Table) -> pa.Table:
    """What is covered in the bodies of a bucket, as spans for each pack."""
    packs, blobs = group.column("pack").to_pylist(), group.column("blob").to_pylist()
    rows, bodies, pack = [], [], []
    for p, b in zip(packs, blobs, strict=True):
        n = int.from_bytes(b[:4], "little")
        part = np.frombuffer(b, BODY, n, 4)
        ends = 4 + n * BODY.itemsize + np.cumsum(part["size"], dtype=np.int64)
        bodies += [b[a:z] for a, z in zip((ends - part["size"]).tolist(), ends.tolist(), strict=True)]
        rows.append(part)
        pack += [p] * n
    rows, packed = np.concatenate(rows), np.array(pack, np.int64)
    order = np.lexsort((rows["id"], rows["key"]))
    rows, packed, bodies = rows[order], packed[order], [bodies[i] for i in order.tolist()]
    first: dict[bytes, int] = {}  # equal bodies have equal keys, so the first row of a body has its smallest document
    source = np.fromiter(map(first.setdefault, bodies, range(len(bodies))), np.int64, len(bodies))
    whole = rows["id"][source] < rows["id"]
    spans = [np.rec.fromarrays([rows["doc"][whole], rows["start"][whole], (rows["start"] + rows["size"])[whole]], SPAN)]
    of = [packed[whole]]
    kinds = np.unique(source)
    names, different = np.unique(rows["key"][kinds], return_counts=True)
    kinds = kinds[np.isin(rows["key"][kinds], names[different > 1])]
    found: dict[int, list[tuple[int, int]]] = {}
    if len(kinds):
        keys, size = rows["key"][kinds], np.cumsum(rows["size"][kinds], dtype=np.int64)
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(kinds))
        begin, done = 0, 0
        for end in ends.tolist():  # whole groups, some TEXT bytes at a time
            if size[end - 1] - done >= TEXT or end == len(kinds):
                part = kinds[begin:end]
                begin, done = end, size[end - 1]
                which, low, high = _with_company([bodies[i] for i in part.tolist()], LENGTH)
                part = part[which].tolist()
                if len(part) > 1:
                    inner = covered([bodies[i][a:z] for i, a, z in zip(part, low.tolist(), high.tolist(), strict=True)], rows["id"][part])
                    found.update((i, [(a + x, a + y) for x, y in spans]) for i, a, spans in zip(part, low.tolist(), inner, strict=True) if spans)
    at = np.flatnonzero(~whole & np.isin(source, np.fromiter(found, np.int64, len(found))))
    extra = [(int(packed[i]), int(rows["doc"][i]), int(rows["start"][i]) + a, int(rows["start"][i]) + z) for i in at.tolist() for a, z in found[int(source[i])]]
    if extra:
        of.append(np.array([e[0] for e in extra], np.int64))
        spans.append(np.array([e[1:] for e in extra], SPAN))
    every, of = np.concatenate(spans), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    every, of = every[order], of[order]
    edges = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else [0]
    parts = [(int(of[a]), joined_spans(every[a:z]).tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"pack": [p for p, _ in parts], "blob": [b for _, b in parts]}, schema=pa.schema([("pack", pa.int64()), ("blob", pa.binary())]))


def removed_mask(size: int, spans: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes the spans cover."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, spans["start"], 1)
    np.add.at(steps, spans["end"], -1)
    return np.cumsum(steps[:-1]) > 0


def _digest(data: bytes, mask: np.ndarray | None) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, maximal removed runs, and the digest of what stays."""
    if mask is None:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest()
    runs = np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1)
    return len(data), int(mask.sum()), int(runs), hashlib.sha256(np.frombuffer(data, np.uint8)[~mask]).hexdigest()


def _kept_text(data: bytes, mask: np.ndarray | None) -> tuple[str]:
    """What stays as text: a character goes if all its bytes do."""
    if mask is None:
        return (data.decode("utf-8", "replace"),)
    own = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((own & 0xC0) != 0x80)
    if len(lead) and lead[0] == 0:
        mask = np.repeat(np.logical_and.reduceat(mask, lead), np.diff(np.append(lead, len(own))))
    return (own[~mask].tobytes().decode("utf-8", "replace"),)


def _finished(finish: Callable, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, m1, m2, what ``finish`` says) of the documents of packs with their spans."""
    kinds = {LongType: pa.int64(), StringType: pa.string()}
    out = pa.schema([("id", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), *((f.name, kinds[type(f.dataType)]) for f in schema)])

    def told(row: dict) -> pa.RecordBatch:
        ids, data, at = _opened(row)
        spans = np.concatenate([np.frombuffer(b, SPAN) for b in row["blobs"]]) if row["blobs"] else np.zeros(0, SPAN)
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        edges = np.searchsorted(spans["doc"], np.arange(len(ids) + 1))
        said = []
        for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = spans[edges[i] : edges[i + 1]]
            said.append(finish(data[a:z], removed_mask(z - a, own) if len(own) else None))
        marks = (pa.array(np.frombuffer(row[m], np.int64)) for m in ("m1", "m2"))
        return pa.RecordBatch.from_arrays([pa.array(ids), *marks, *(pa.array(c, f.type) for c, f in zip(zip(*said, strict=True), list(out)[3:], strict=True))], schema=out)

    return lambda batches: (told(row) for row in _rows(batches))


def _judged(docs: DataFrame, finish: Callable, schema: StructType, *, id_col: str, text_col: str) -> DataFrame:
    """``row, bare, text, copy, found`` for every row: the other columns as a struct, whether its text is null, the text, whether it copies a document with a smaller id, and what ``finish`` says of it (null for copies and texts shorter than LENGTH)."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be of an integer type")
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]
    keyed = docs.select(F.struct(*others).alias("row"), F.col(text_col).isNull().alias("bare"), text.alias("text"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(1), text).alias("m2"))
    long = keyed.where(F.octet_length("text") >= LENGTH).select("id", "m1", "m2", "text")
    firsts = stored(long.groupBy("m1", "m2").agg(F.min("id").alias("id")), "firsts")
    single = long.repartition("id", "m1", "m2").join(firsts, ["id", "m1", "m2"], "left_semi")
    packs = stored(single.mapInArrow(_packs, "pack long, ids binary, m1 binary, m2 binary, sizes binary, data binary"), "packs")
    size = packs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, 3 * size / BUCKET)))))
    tasks = 1 << bits  # named, so that small blobs, which mean much work, aren't coalesced to few tasks
    opened = packs.select("pack", "ids", "sizes", "data").repartition(tasks, "pack")
    told = opened.mapInArrow(_anchors(bits), BLOB_SQL).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_repeated, "pack long, blob binary")
    repeated = stored(told.repartition(tasks, "pack").groupBy("pack").agg(F.collect_list("blob").alias("blobs")), "anchors")
    bodies = stored(opened.join(repeated, "pack").mapInArrow(_bodies(bits), BLOB_SQL), "bodies")
    settled = bodies.where(F.col("bucket") >= 0).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_settled, "pack long, blob binary")
    spans = settled.unionByName(bodies.where(F.col("bucket") == LOCAL).select("pack", "blob")).groupBy("pack").agg(F.collect_list("blob").alias("blobs"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    found = stored(packs.repartition(tasks, "pack").join(stored(spans, "spans"), "pack", "left").mapInArrow(_finished(finish, schema), f"id long, m1 long, m2 long, {fields}"), "found")
    found = found.select("id", "m1", "m2", F.struct(*schema.names).alias("found"))
    copy = F.col("found").isNull() & (F.octet_length("text") >= LENGTH)
    return keyed.join(found, ["id", "m1", "m2"], "left").select("row", "bare", "text", copy.alias("copy"), "found")


DIGEST = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, removal`` for every row of ``docs``: its columns but for the text as a struct, and a struct of the text's bytes, removed bytes, maximal removed runs and the digest of what stays.

    Null texts are empty.  Documents without an id come after all others and don't affect
    each other, nor do rows with equal ids; ids must be of an integer type.  Texts shorter
    than LENGTH lose nothing.  Extra columns ride along in ``row``, whatever their names.
    """
    judged = _judged(docs, _digest, DIGEST, id_col=id_col, text_col=text_col)
    n = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    plain = F.when(F.col("copy"), F.struct(n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))).otherwise(
        F.struct(n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))
    return judged.select("row", F.coalesce("found", plain).alias("removal"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what is repeated cut from their texts, the other columns as they are.

    A character goes if all its bytes do, so that what stays is text.  Null texts stay null.
    Otherwise as ``removals``.
    """
    judged = _judged(docs, _kept_text, StructType([StructField("kept", StringType())]), id_col=id_col, text_col=text_col)
    cut = F.when(~F.col("bare"), F.when(F.col("copy"), "").otherwise(F.coalesce("found.kept", "text")))
    return judged.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from, and kept of, every document."""
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "removal.*")


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
SQL: dict[str, str] = {}
