"""Lexical search (BM25) and vector search over chunks."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.session import cut

K1, B, SYMBOL_BOOST = 1.5, 0.75, 2.0


def query_tokens(spark, query: str) -> list[str]:
    """The query's tokens, repeats included, as chunks are tokenised."""
    return spark.range(1).select(text.tokens(F.lit(query)).alias("t")).first().t


def corpus_statistics(tokenised: DataFrame) -> DataFrame:
    """One row of ``tokenised`` (tokens): n documents and mean tokens per document, those without tokens included."""
    return tokenised.agg(*_totals(F.size("tokens")))


def _totals(length: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(length), F.lit(0.0)).alias("mean")]


def document_frequency(tokenised: DataFrame) -> DataFrame:
    """token, df: documents that contain each token."""
    return tokenised.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _count(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def bm25(chunks: DataFrame, query: list[str], body: str = "text", symbol: str | None = None, boost: float = SYMBOL_BOOST) -> DataFrame:
    """Chunks that share a token with ``query``, with ``raw`` and ``score`` (raw to four digits).

    Only the query's tokens are counted, in one pass over the texts that keeps a count per query token and the length of
    each document: nothing is exploded or shuffled but the one row of corpus statistics. ``symbol``: a column whose tokens
    double the score if they hold the whole query.
    """
    wanted = list(dict.fromkeys(query))
    if not wanted:
        return chunks.where("false").withColumn("raw", F.lit(0.0)).withColumn("score", F.lit(0.0))
    raw, corpus, hit = _scored(_measured(chunks, wanted, body), query)
    if symbol is not None:
        whole = F.size(F.array_except(F.array(*map(F.lit, wanted)), text.tokens(F.col(symbol)))) == 0
        raw = raw * F.when(whole, boost).otherwise(1.0)
    return hit.join(F.broadcast(corpus)).withColumn("raw", raw).withColumn("score", F.round("raw", 4)).select(*chunks.columns, "raw", "score")


def bm25_keys(chunks: DataFrame, query: list[str], key: str, body: str = "text") -> DataFrame:
    """``key``, ``raw`` and ``score`` of what ``bm25`` finds. The texts are tokenised once: a few numbers a chunk are kept."""
    wanted = list(dict.fromkeys(query))
    if not wanted:
        return chunks.where("false").select(key, F.lit(0.0).alias("raw"), F.lit(0.0).alias("score"))
    raw, corpus, hit = _scored(cut(_measured(chunks, wanted, body).select(key, "_tf", "_len")), query)
    return hit.join(F.broadcast(corpus)).select(key, raw.alias("raw")).withColumn("score", F.round("raw", 4))


def _measured(chunks: DataFrame, wanted: list[str], body: str) -> DataFrame:
    """Adds ``_tf``, the count of each wanted token, and ``_len``, that of all tokens."""

    def counted(tokens: Column) -> Column:
        each = F.array(*(_count(tokens, q) for q in wanted))
        return F.struct(F.size(tokens).alias("len"), each.alias("tf"))

    # a lambda's variable is computed once, a column would be tokenised anew for each use
    row = F.element_at(F.transform(F.array(text.tokens(F.col(body))), counted), 1)
    return chunks.withColumn("_row", row).withColumn("_tf", F.col("_row.tf")).withColumn("_len", F.col("_row.len")).drop("_row")


def _scored(rows: DataFrame, query: list[str]) -> tuple[Column, DataFrame, DataFrame]:
    """(the raw score, the row of corpus statistics that it reads, the rows with a token of the query)."""
    repeats = Counter(query)
    frequencies = [F.count_if(F.get("_tf", F.lit(k)) > 0).alias(f"_df{k}") for k in range(len(repeats))]
    n, mean = _totals(F.col("_len"))
    corpus = rows.agg(n.alias("_n"), mean.alias("_mean"), *frequencies)  # one row
    norm = F.when(F.col("_mean") > 0, K1 * (1 - B + B * F.col("_len") / F.col("_mean"))).otherwise(F.lit(K1))
    raw = F.lit(0.0)
    for k, times in enumerate(repeats.values()):
        tf = F.get("_tf", F.lit(k))
        part = inverse_frequency(F.col("_n"), F.col(f"_df{k}")) * tf * (K1 + 1) / (tf + norm)
        raw = raw + F.when(tf > 0, times * part).otherwise(0.0)
    return raw, corpus, rows.where(F.exists("_tf", lambda n: n > 0))


#: Parts of a token index.
BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def token_counts(tokens: Column) -> Column:
    """Array of (token, tf) of the distinct tokens: where runs of equal ones begin in sorted order, and how far they go."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        entry = lambda at: lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))
        return F.element_at(F.transform(F.array(begins), lambda at: F.transform(at, entry(at))), 1)

    return F.element_at(F.transform(F.array(F.sort_array(tokens)), runs), 1)


def save_tokens(chunks: DataFrame, folder: str, key: str, body: str = "text") -> None:
    """Write an index for many queries: each token's chunks with its count and their length, in buckets by token, and the
    corpus statistics. A chunk's tokens are counted in its row, so that they are shuffled once, into their buckets; a token
    that most chunks have is split over tasks."""
    rows = chunks.select(key, text.tokens(F.col(body)).alias("tokens"))
    each = rows.select(key, F.size("tokens").alias("len"), F.inline(token_counts(F.col("tokens"))))
    each = each.withColumn("bucket", _bucket(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
    each.write.partitionBy("bucket").parquet(f"{folder}/tokens")
    corpus_statistics(rows).write.parquet(f"{folder}/statistics")


def find_tokens(spark, folder: str, query: list[str], key: str) -> DataFrame:
    """key, raw, score of the chunks that share a token with ``query``: what ``bm25`` finds, from an index, of which only
    the buckets of the query's tokens are read."""
    repeats = Counter(query)
    asked = spark.createDataFrame(list(repeats.items()), "token string, times int")
    buckets = [r.b for r in asked.select(_bucket(F.col("token")).alias("b")).distinct().collect()]  # one a token at most
    hits = spark.read.parquet(f"{folder}/tokens").where(F.col("bucket").isin(buckets)).join(F.broadcast(asked), "token")
    found = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row a token
    hits = hits.join(F.broadcast(found), "token").join(F.broadcast(spark.read.parquet(f"{folder}/statistics")))
    norm = F.when(F.col("mean") > 0, K1 * (1 - B + B * F.col("len") / F.col("mean"))).otherwise(F.lit(K1))
    part = F.col("times") * inverse_frequency(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy(key).agg(F.sum(part).alias("raw")).withColumn("score", F.round("raw", 4))


def top_hits(scored: DataFrame, limit: int, min_score: float = 0.0, order: tuple[str, ...] = ("path", "lineno")) -> DataFrame:
    return scored.where(F.col("raw") > min_score).orderBy(F.desc("score"), *order).limit(limit)


# --- vectors


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot_product(v: Column, query: list[float]) -> Column:
    """Dot product with a literal vector, unrolled: a sum of products inside whole-stage code."""
    terms = [F.get(v, F.lit(k)).cast("double") * F.lit(float(q)) for k, q in enumerate(query) if q]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def cosine_hits(rows: DataFrame, vector: str, query: list[float], limit: int, min_score: float, order: tuple[str, ...], unit: bool = False) -> DataFrame:
    """The ``limit`` rows most similar to ``query``, strictly above ``min_score``, with ``score`` to four digits.

    ``unit``: the stored vectors have length one. A zero query has no hits. Each row is one scan and a bounded heap.
    """
    size = float(np.sqrt(np.square(np.asarray(query, float)).sum())) if query else 0.0
    if size == 0:
        return rows.where("false").withColumn("raw", F.lit(0.0)).withColumn("score", F.lit(0.0))
    raw = dot_product(F.col(vector), [q / size for q in query])
    if not unit:
        length = norm(F.col(vector))
        raw = F.when(length > 0, raw / length).otherwise(0.0)
    scored = rows.withColumn("raw", raw).where(F.col("raw") > min_score).withColumn("score", F.round("raw", 4))
    return scored.orderBy(F.desc("score"), *order).limit(limit)


class HashEmbedder:
    """Texts to counts of hashed tokens: needs no model and gives the same vectors everywhere."""

    def __init__(self, dimensions: int = 256, name: str | None = None):
        self.dimensions, self.model_name = dimensions, name or f"token-hash-{dimensions}"

    def embed(self, tokens: list[str]) -> np.ndarray:
        v = np.zeros(self.dimensions)
        for token, n in Counter(tokens).items():
            v[int(hashlib.sha1(token.encode()).hexdigest(), 16) % self.dimensions] += n
        size = np.sqrt((v * v).sum())
        return v / size if size else v


def embedded(rows: DataFrame, embedder, body: str = "text", out: str = "embedding") -> DataFrame:
    """Adds unit vectors. An embedder takes batches of texts (``embed_texts``), or the tokens of one text, which Spark finds."""
    whole = hasattr(embedder, "embed_texts")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = embedder.embed_texts(batch.tolist()) if whole else [embedder.embed(list(t)) for t in batch]
            yield pd.Series([_unit(v).astype(np.float32).tolist() for v in found], dtype=object)

    vectors: Callable = F.pandas_udf(run, "array<float>")
    return rows.withColumn(out, vectors(F.coalesce(body, F.lit("")) if whole else text.tokens(F.col(body))))


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.sqrt(np.square(v).sum()))
    return v / size if size else v


def query_vector(spark, embedder, query: str) -> list[float]:
    found = embedder.embed_texts([query])[0] if hasattr(embedder, "embed_texts") else embedder.embed(query_tokens(spark, query))
    return _unit(np.asarray(found, float)).tolist()
