"""Repeated passages by a depth-limited radix sort of byte suffixes.

A byte goes if a window of ``THRESHOLD`` bytes around it also starts earlier. Suffixes matter through that depth only, so
they are sorted digit by digit, most significant first, and the sort ends there: what is still equal is repeated. Groups of
one are dropped after each digit.

The first digit is one that text chooses itself: of the ``GRAM``-byte grams inside a window the one with the least hash
(the leftmost of equals), its anchor. Equal windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs, so one row in about thirty-five bytes is dealt out by this digit. It only decides what is unique: every
repeat is decided on bytes. What is left is dealt out with its context, the bytes of all windows of the anchor. A context
that an earlier suffix has too is repeated as a whole; the windows of the anchor's other contexts go through the passes
over their bytes, eight a digit.

Hot anchors (the edges of a passage that follows other words in each document) are split: the task that reads the texts
combines equal contexts, and of an anchor with more than ``SPARSE`` contexts among those that it holds it deals them out in
``SALTS`` ways by their bytes, with a note for those of other tasks. A task that sorts such contexts, or meets the note or more
than ``PIECE`` contexts, does so a piece at a time and deals out the windows that are left. Only these windows are compared by
a 128-bit hash.

Suffixes are ordered by (doc_id, hash of the text, position).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import map_rows, table, text_of

THRESHOLD = 100
GRAM = 32
#: Anchors, and contexts, that a task combines before it deals them out.
COMBINED, HELD = 1 << 20, 100_000
#: Most contexts of one anchor that a task deals out of those it holds.
SPARSE = 16
#: Ways in which the contexts of a dense anchor are dealt out.
SALTS = 256
#: Most contexts of one anchor that are sorted at once.
PIECE = 1024
#: Windows that are sorted at once, besides the last anchor's.
SORTED = 400_000
#: Windows whose anchors are found at once.
_PIECE = 1 << 22
_LAST = (1 << 63) - 1
_POSITION = (1 << 32) - 1


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position, by doubling."""
    h, size = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's windows in order: position, gram hash, first and last window start that each stands for."""
    starts = len(text) - THRESHOLD + 1
    if starts < 1:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    span = THRESHOLD - GRAM + 1
    found, hashes, firsts = [], [], []
    x = np.frombuffer(text, np.uint8)
    for at in range(0, starts, _PIECE):
        n = min(_PIECE, starts - at)
        h = _gram_hashes(x[at : at + n + THRESHOLD - 1])
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        low, size = (mixed & np.uint64(~0x7FFFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :]) & np.uint64(0x7FFFFF)
        turns = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        here = low[turns].astype(np.int64)
        found.append(here + at)
        hashes.append(h[here])
        firsts.append(turns + at)
    position, gram, first = map(np.concatenate, (found, hashes, firsts))
    if len(found) > 1:  # an anchor that goes on across pieces
        fresh = np.concatenate([[True], position[1:] != position[:-1]])
        position, gram, first = position[fresh], gram[fresh], first[fresh]
    return position, gram, first, np.append(first[1:], starts) - 1


def _tie(text: bytes) -> int:
    """31 bits that order texts of one doc_id."""
    return int.from_bytes(hashlib.md5(text).digest()[:4], "big") >> 1


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of (doc, text), ``route`` being its gram, ``n`` one or two: of a gram that a task holds several
    times one row tells the others' tasks; the rest are known to be no group of one and routed anywhere."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram, doc, place = map(np.concatenate, zip(*held))
        held.clear()
        order = np.argsort(gram, kind="stable")
        turn = np.concatenate([[True], np.diff(gram[order]) != 0])
        new, several = np.empty(len(gram), bool), np.empty(len(gram), bool)
        new[order], several[order] = turn, ~turn | ~np.append(turn[1:], True)
        anywhere = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        route = (np.where(new, gram, anywhere) >> np.uint64(16)).view(np.int64)  # a collision only keeps what could go
        for at in range(0, len(route), 100_000):
            here = slice(at, at + 100_000)
            yield _batch([route[here], doc[here], place[here], several[here].astype(np.int8) + np.int8(1)], "route doc place n")

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            position, gram, _, _ = anchors(text)
            held.append((gram, np.full(len(gram), doc, np.int64), position + (_tie(text) << 32)))
            size += len(gram)
            if size >= COMBINED:
                yield from flush()
                size = 0
    if size:
        yield from flush()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their one shuffle."""
    from zstandard import ZstdCompressor

    pack = ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array(map(pack, batch.column(3).to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "doc", "tie", "packed"])


def _unpacked(packed: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(packed)


class _Rows:
    """Rows on their way to the next task: contexts (``low`` is one if their anchor is split), notes that an anchor is split
    (no bytes), windows (``lead`` -1) and settled spans (``lead`` is their size, negative, which is -THRESHOLD at most)."""

    schema = "route long, low long, doc long, place long, lead int, bytes binary"

    def __init__(self):
        self.parts: list[tuple] = []
        self.loose: list[tuple] = []

    def context(self, gram: int, doc: int, place: int, lead: int, part: bytes) -> None:
        self.loose.append((gram, 0, doc, place, lead, part))

    def salted(self, gram: int, doc: int, place: int, lead: int, part: bytes) -> None:
        salt = zlib.crc32(part) % SALTS + 1
        route = (gram ^ salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1
        self.loose.append((route - (route >> 63 << 64), 1, doc, place, lead, part))

    def note(self, gram: int) -> None:
        self.loose.append((gram, 0, 0, 0, 0, b""))

    def settled(self, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Bytes from ``place`` on; ``size`` of them."""
        self.parts.append((place, doc, doc, place, (-size).astype(np.int32)))

    def windows(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((high, low, doc, place, np.full(len(doc), -1, np.int32)))

    def __len__(self) -> int:
        return len(self.loose) + sum(len(p[0]) for p in self.parts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = "route low doc place lead bytes"
        for at in range(0, len(self.loose), 20_000):
            columns = list(zip(*self.loose[at : at + 20_000]))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names.split())
        if self.parts:
            whole = [np.concatenate(c) for c in zip(*self.parts)]
            for at in range(0, len(whole[0]), 100_000):
                part = [c[at : at + 100_000] for c in whole]
                yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.nulls(len(part[0]), pa.binary())], names.split())
        self.parts, self.loose = [], []


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (doc, place, size) with those that touch made one."""
    doc, place, size = spans[np.lexsort((spans[:, 1], spans[:, 0]))].T
    # the ends grow with the places, as contexts of later anchors end later
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + size[:-1])])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[first], place[first], place[last] + size[last] - place[first]


#: A context: gram, doc, place of the anchor, bytes before it, bytes.
_Context = tuple[int, int, int, int, bytes]


def _contexts(batches: Iterator[pa.RecordBatch], sparse: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the asked anchors of (doc_id, doc, tie, packed text, positions less 2**31)."""
    held: dict[bytes, _Context] = {}
    rows = _Rows()

    def flush() -> Iterator[pa.RecordBatch]:
        by_gram: dict[int, list[_Context]] = {}
        for c in held.values():
            by_gram.setdefault(c[0], []).append(c)
        held.clear()
        for gram, some in by_gram.items():
            if len(some) > sparse:
                rows.note(gram)
                for c in some:
                    rows.salted(*c)
            else:
                for c in some:
                    rows.context(*c)
        yield from rows.batches()

    for batch in batches:
        for doc, tie, packed, places in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            text = _unpacked(packed)
            position, gram, first, last = anchors(text)
            asked = np.unique(np.array(places, np.int64) + (1 << 31))
            at = np.searchsorted(position, asked)
            at = at[(at < len(position)) & (position[np.minimum(at, len(position) - 1)] == asked)]  # all, unless ties collide
            later: list[tuple[int, int, int]] = []
            numbers = gram[at].view(np.int64), position[at] + (tie << 32), position[at] - first[at], first[at], last[at] + THRESHOLD
            for g, p, lead, begin, end in zip(*(x.tolist() for x in numbers)):
                part = text[begin:end]
                before = held.setdefault(part, here := (g, doc, p, lead, part))
                if before is not here:
                    if before[1:3] > (doc, p):
                        held[part] = here
                        later.append((before[1], before[2] - lead, len(part)))
                    elif before[1:3] < (doc, p):
                        later.append((doc, p - lead, len(part)))
            if later:
                rows.settled(*_merged(np.array(later, np.int64)))
            if len(held) + len(rows) >= HELD:
                yield from flush()
    yield from flush()


def radix_groups(digits: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes at ``starts`` of the bytes ``digits``, inside given groups.

    Returns (suffix, group) of those that share their first ``depth`` bytes with another of their group, by group.
    """
    alive = np.arange(len(starts))
    for at in [None, *range(0, depth, 8)]:
        if at is not None:
            here = min(at, depth - 8)  # the last digit overlaps the one before
            digit = np.zeros(len(alive), np.uint64)
            for k in range(8):
                digit = digit << np.uint64(8) | digits[starts[alive] + (here + k)]
            order = np.lexsort((digit, group))
            alive, group, digit = alive[order], group[order], digit[order]
            new = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            order = np.argsort(group, kind="stable")
            alive, group = alive[order], group[order]
            new = group[1:] != group[:-1]
        if not len(alive):
            break
        edge = np.concatenate([[True], new, [True]])
        group = np.cumsum(edge[:-1])
        several = ~(edge[:-1] & edge[1:])
        alive, group = alive[several], group[several]
    return alive, group


def _sort(contexts: list[_Context], rows: _Rows, split: bool) -> None:
    """Settle the windows of different contexts that start earlier in another of the same anchor.

    ``split``: the anchors have contexts elsewhere, too, so that the windows that are left go on by their hashes.
    """
    grams, docs, places, leads, parts = zip(*contexts)
    docs, places, leads = (np.array(x, np.int64) for x in (docs, places, leads))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = sizes - (THRESHOLD - 1)
    of = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.cumsum(sizes) - sizes
    # the first digit: the anchor and its offset in the window
    _, key = np.unique(np.array(grams, np.int64), return_inverse=True)
    offset = leads[of] - inside
    data = b"".join(parts)
    suffix, group = radix_groups(np.frombuffer(data, np.uint8), begin[of] + inside, key[of] * THRESHOLD + offset)
    rank = np.empty(len(parts), np.int64)
    rank[np.lexsort((places, docs))] = np.arange(len(parts))
    # the earliest of each group stays
    order = np.lexsort((rank[of[suffix]], group))
    suffix, group = suffix[order], group[order]
    gone = np.sort(suffix[1:][group[1:] == group[:-1]])
    if len(gone):
        stop = np.flatnonzero((np.diff(gone) != 1) | (np.diff(of[gone]) != 0))
        first, last = gone[np.concatenate([[0], stop + 1])], gone[np.append(stop, len(gone) - 1)]
        at = of[first]
        rows.settled(docs[at], places[at] - leads[at] + inside[first], last - first + THRESHOLD)
    if split:
        from xxhash import xxh3_128_digest

        left = np.ones(len(of), bool)
        left[gone] = False
        left = np.flatnonzero(left)
        hashes = b"".join(xxh3_128_digest(data[k : k + THRESHOLD]) for k in (begin[of[left]] + inside[left]).tolist())
        high, low = np.frombuffer(hashes, np.int64).reshape(-1, 2).T
        at = of[left]
        rows.windows(high, low, docs[at], places[at] - leads[at] + inside[left])


def _decided(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (route, bytes, doc, place), so that of equal contexts the earliest comes first, and notes before all;
    whole anchors are sorted together, as many as fit."""
    rows = _Rows()
    full: list[_Context] = []  # of anchors that are complete
    held: list[_Context] = []  # of the present one
    windows = 0
    gram, split = None, False

    def close() -> None:
        nonlocal windows
        if split and held:
            _sort(held, rows, split=True)
        elif len(held) > 1:
            full.extend(held)
            windows += sum(len(c[4]) - THRESHOLD + 1 for c in held)
        held.clear()
        if windows >= SORTED:
            _sort(full, rows, split=False)
            full.clear()
            windows = 0

    for batch in batches:
        loose = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        if loose.any():
            rows.parts.append(tuple(c.to_numpy()[loose] for c in batch.columns[:5]))
            batch = batch.filter(pa.array(~loose))
        later: list[tuple[int, int, int]] = []
        for g, salted, d, p, lead, part in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if g != gram:
                close()
                gram, split = g, False
            split = split or salted == 1
            if not part:
                split = True
            elif held and held[-1][4] == part:
                if (d, p) > held[-1][1:3]:
                    later.append((d, p - lead, len(part)))
            else:
                if len(held) >= piece:
                    split = True
                    _sort(held, rows, split=True)
                    held.clear()
                held.append((g, d, p, lead, part))
        if later:
            rows.settled(*np.array(later, np.int64).T)
        yield from rows.batches()
    close()
    if full:
        _sort(full, rows, split=False)
    yield from rows.batches()


def _cut_out(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = _unpacked(packed)
                edges = np.zeros(len(text) + 1, np.int32)
                if spans:
                    start = np.array(spans, np.int64) >> 24
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + (np.array(spans, np.int64) & 0xFFFFFF), -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                count = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
                out.append((doc_id, len(text), int(gone.sum()), count, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + with_text]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def remove_repeats(documents: DataFrame, with_text: bool = False, sparse: int = SPARSE, piece: int = PIECE) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds kept_bytes.

    A null text is empty; texts shorter than a window lose nothing. Null ids come last in the order of documents; texts
    that share an id are ordered by their hash; rows repeated with id and text are one document and judged alike. Other
    columns are ignored. What is kept is bytes: a cut may fall inside a character. ``sparse`` and ``piece`` bound what one
    task does for one anchor; they change no result.
    """
    raw = text_of().cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), raw.alias("text"))
    found = map_rows(texts.where(F.length("text") >= THRESHOLD).select("doc", "text"), _anchor_rows, "route long, doc long, place long, n byte")
    several = found.withColumn("n", F.sum("n").over(Window.partitionBy("route"))).where("n > 1")
    tie_of = F.shiftright("place", 32).alias("tie")
    asked = several.groupBy("doc", tie_of).agg(F.collect_list((F.col("place").bitwiseAND(F.lit(_POSITION)) - (1 << 31)).cast("int")).alias("places"))

    # the texts' one shuffle serves both joins
    tie = F.shiftrightunsigned(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long"), 1)
    packed = map_rows(texts.select("doc_id", "doc", tie.alias("tie"), "text"), _packed, "doc_id long, doc long, tie long, packed binary")
    packed = packed.where("doc IS NOT NULL AND tie IS NOT NULL")  # as an inner join asks, so that both joins share a plan
    once = packed.join(asked, ["doc", "tie"]).select("doc_id", "doc", "tie", "packed", "places")
    contexts = map_rows(once, partial(_contexts, sparse=sparse), _Rows.schema)
    dealt = contexts.repartition("route").sortWithinPartitions("route", "bytes", "doc", "place")
    decided = map_rows(dealt, partial(_decided, piece=piece), _Rows.schema)

    settled = F.col("lead") < -1
    turn = F.row_number().over(Window.partitionBy("route", "low").orderBy("doc", "place"))
    spans = decided.withColumn("turn", turn).where(settled | (F.col("turn") > 1))
    span = F.shiftleft(F.col("place").bitwiseAND(F.lit(_POSITION)), 24) + F.when(settled, -F.col("lead")).otherwise(THRESHOLD)
    marks = spans.select("doc", tie_of, span.alias("span")).groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))
    whole = packed.join(marks, ["doc", "tie"], "left").select("doc_id", "packed", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return map_rows(whole, _cut_out(with_text), schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
