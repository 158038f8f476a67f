"""SimHash near-duplicates with BK-trees.

Distinct fingerprints only are compared. Cut into radius + 3 blocks of bits, two of them within ``radius`` bits agree in
three blocks at least, so each goes to one shard for every choice of three, named by the choice and the blocks' values: at
radius 3 twenty shards, named by half of the bits, so that a shard hardly grows with the corpus and mostly holds one. A
shard's fingerprints form a BK-tree (a child's key is its distance to its parent) that is searched along the edges within the
radius. The trees are built where their shards are dealt out instead of being broadcast: all of them together are the
corpus, which has no bound. Shards beyond ``SHARD`` members (dense groups of near copies) are cut into pieces, each piece's
tree being searched for the members of each piece: bounded memory, no pair lost. Of the links that a tree finds, those that
close a cycle are not needed for the components and are not written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, keep_rows, map_rows, table, text_of
from graphloom.llm.components import connected_components

RADIUS = 3
#: Most members of a tree.
SHARD = 4096
#: Up to so many large shards are made known by broadcast.
FEW = 50_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the XXH64 (seed 42) bits of all word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = (ends - size + 1)[: len(words) - shingle + 1].tolist()
        pieces = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += part.sum(0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * set_bits > len(hashes)))


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and key (hash of the text) of every row, from its whole text (null:
    empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "key"])

    text = text_of().cast("binary")
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    return map_rows(narrow, run, "doc_id long, fp long, key binary")


class BKTree:
    """Fingerprints; children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of the members within ``radius`` of ``value``."""
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            n = todo.pop()
            distance = (values[n] ^ value).bit_count()
            if distance <= radius:
                found.append(n)
            low, high = distance - radius, distance + radius
            todo += [child for key, child in children[n].items() if low <= key <= high]
        return found

    def add(self, value: int) -> None:
        new = len(self.values)
        n = 0
        while new:
            distance = (self.values[n] ^ value).bit_count()
            if (child := self.children[n].get(distance)) is None:
                self.children[n][distance] = new
                break
            n = child
        self.values.append(value)
        self.children.append({})


def _shard_links(values: list[int], mine: list[bool] | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest: among all values, or (``mine`` given) between the tree of these and the others."""
    parent = list(range(len(values)))

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    tree, members, links = BKTree(), [], []
    order = range(len(values)) if mine is None else sorted(range(len(values)), key=lambda n: not mine[n])
    for n in order:
        if mine is None or not mine[n]:
            for k in tree.search(values[n], radius):
                a, b = root(n), root(members[k])
                if a != b:
                    parent[a] = b
                    links.append((values[n], values[members[k]]))
        if mine is None or mine[n]:
            tree.add(values[n])
            members.append(n)
    return links


def shards_of(fp: Column, radius: int) -> Column:
    """The shards of a fingerprint, an array of longs: the choice of three blocks and their bits."""
    n = radius + 3
    edges = [64 * k // n for k in range(n + 1)]
    found = []
    for number, chosen in enumerate(combinations(range(n), 3)):
        shard, at = F.lit(0).cast("long"), 0
        for k in chosen:
            width = edges[k + 1] - edges[k]
            shard = shard.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << width) - 1)), at))
            at += width
        found.append(shard.bitwiseOR(F.lit(number << at)) if at < 64 else shard)
    return F.array(*found)


def near_links(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp) that connect all pairs within ``radius`` bits."""
    members = distinct.select("fp", F.explode(shards_of(F.col("fp"), radius)).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = cut(sizes.select("shard", F.ceil(F.col("n") / most).cast("int").alias("pieces")))
    few = large.limit(FEW + 1).count() <= FEW
    members = members.join(F.broadcast(large) if few else large, "shard", "left")
    piece = F.pmod(F.xxhash64("fp"), F.coalesce("pieces", F.lit(1))).cast("int")
    members = members.select("fp", "shard", piece.alias("piece"), F.coalesce("pieces", F.lit(1)).alias("pieces"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    members = members.select("fp", "shard", "piece", F.least("piece", "other").alias("tree"), F.greatest("piece", "other").alias("asks"))
    shards = members.repartition("shard", "tree", "asks").sortWithinPartitions("shard", "tree", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the shard that the last batch ended in

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            rows = np.concatenate([*held, rows])
            cuts = np.flatnonzero((rows[1:, [1, 3, 4]] != rows[:-1, [1, 3, 4]]).any(1)) + 1
            held = [rows[cuts[-1] if len(cuts) else 0 :]]
            yield _links_batch(links(rows, np.concatenate([[0], cuts])))
        if held:
            yield _links_batch(links(held[0], np.array([0, len(held[0])])))

    def links(rows: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        several = np.flatnonzero(np.diff(cuts) > 1)
        for start, end in zip(cuts[several].tolist(), cuts[several + 1].tolist()):
            values, piece, (tree, asks) = rows[start:end, 0].view(np.uint64).tolist(), rows[start:end, 2], rows[start, 3:]
            out += _shard_links(values, (piece == tree).tolist() if tree != asks else None, radius)
        return out

    return map_rows(shards, run, "a long, b long")


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = 3, most: int = SHARD) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of at most ``radius`` bits, the row's own
    included. Null and empty texts have fingerprint zero, linked like any other; null ids do not name a component that has
    another id; repeated rows share a fingerprint, hence a component. Other columns are ignored.
    """
    named = _components(documents, radius, shingle, most)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(documents: DataFrame, radius: int, shingle: int, most: int) -> DataFrame:
    """doc_id, fp, key, component_id."""
    rows = cut(fingerprints(documents, shingle))
    vertices = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(connected_components(near_links(vertices.select("fp"), radius, most)))
    linked = vertices.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left")
    names = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("named"))
    named = linked.join(names, "root", "left").select("fp", F.coalesce("named", "least").alias("component_id"))
    return rows.join(named, "fp")


def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = 3, most: int = SHARD) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns: those whose doc_id names their component, equal texts
    once. Different texts of that id stay both, and so do those of components that have null ids only."""
    named = _components(documents, radius, shingle, most)
    return keep_rows(documents, cut(named.where("doc_id <=> component_id").select("doc_id", "key").distinct()))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
