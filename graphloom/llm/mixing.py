"""Mixing sources to target weights by iterative proportional fitting.

Documents are measured in one pass over their texts and counted into cells (source, language, topic); only cells take part
in the fitting. Each step scales the cells so that the token sums of one margin meet their targets; the steps go round the
margins. A
cell's weight over its tokens is the number of copies that each of its documents should have: its whole part is given to
all, the rest by a draw that depends on the document's id alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, table, text_of, union_all

MARGINS = ("source", "lang", "topic")
#: Target shares: a mapping of value to share, or the power to which the present shares are raised before they are scaled.
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 8
SEED = "mix-1"
#: Up to so many cells are fitted by one task, and joined with the documents by broadcast.
FEW = 50_000


def topic(words: Column, text: Column) -> Column:
    """The register of a text: marked up, in short lines, short, or prose."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.when(10 * symbols > words, "symbols").when(words < 50, "short").when(20 * lines > words, "lists").otherwise("prose")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words of the whole text); null names and texts are empty."""
    text, name = text_of(), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), name("source"), name("lang"), topic(words, text).alias("topic"), words.alias("n_tokens"))


def _margin(cells: DataFrame, margin: str, target: Mapping[str, float] | float) -> DataFrame:
    """margin, value, target (the tokens that the value should have in all) and factor (one)."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("has"))
    if isinstance(target, Mapping):
        pairs = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col("value")), F.lit(0.0)) if pairs else F.lit(0.0)
        wanted = F.when(F.col("has") > 0, wanted).otherwise(0.0)
    else:
        wanted = F.pow("has", F.lit(float(target)))
    sums = sums.withColumn("wanted", wanted)
    all_has, all_wanted = sums.agg(F.sum("has"), F.sum("wanted")).first()  # two numbers
    share = F.col("wanted") * F.lit(all_has) / F.lit(all_wanted) if all_wanted else F.col("has")
    return sums.select(F.lit(margin).alias("margin"), "value", share.alias("target"), F.lit(1.0).alias("factor"))


def _scaled(cells: DataFrame, factors: Mapping[str, DataFrame], margins: Sequence[str]) -> tuple[DataFrame, Column]:
    """``cells`` with the factors of some margins, and their tokens times these."""
    weight = F.col("tokens").cast("double")
    for m in margins:
        cells = cells.join(factors[m].select(F.col("value").alias(m), F.col("factor").alias(f"f_{m}")), m)
        weight = weight * F.col(f"f_{m}")
    return cells, weight


def _fit_many(cells: DataFrame, table: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """A cell's weight is its tokens times a factor for its value of each margin. A step sums the cells by one margin,
    combined before the shuffle, so that a value that most cells have is never gathered, and sets this margin's factors."""
    for _ in range(rounds):
        factors = {m: table.where(F.col("margin") == m) for m in MARGINS}
        for m in MARGINS:
            rest, weight = _scaled(cells, factors, [o for o in MARGINS if o != m])
            sums = rest.groupBy(F.col(m).alias("value")).agg(F.sum(weight).alias("has"))
            step = F.when(F.col("has") > 0, F.col("target") / F.col("has")).otherwise(F.col("factor"))
            factors[m] = cut(factors[m].join(sums, "value").select("margin", "value", "target", step.alias("factor")))
        table = union_all(list(factors.values()))
    every, weight = _scaled(cells, {m: table.where(F.col("margin") == m) for m in MARGINS}, MARGINS)
    return table, cut(every.select(*cells.columns, weight.alias("weight")))


def _fit_few(cells: DataFrame, table: DataFrame, rounds: int) -> DataFrame:
    """The same on one task's rows, without a shuffle."""
    columns = cells.columns
    for m in MARGINS:
        cells = cells.join(F.broadcast(table.where(F.col("margin") == m).select(F.col("value").alias(m), F.col("target").alias(f"t_{m}"))), m)
    cells = cells.coalesce(1).withColumn("weight", F.col("tokens").cast("double"))
    for k in range(rounds):
        for m in MARGINS:
            has = F.sum("weight").over(Window.partitionBy(m))
            scaled = F.when(has > 0, F.col("weight") * F.col(f"t_{m}") / has).otherwise(F.col("weight"))
            cells = cells.withColumn("weight", scaled)
        if k % 4 == 3:
            cells = cut(cells)
    return cut(cells.select(*columns, "weight"))


def fit(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``cells`` (the margins, tokens) with ``weight``, the fitted tokens; and a report: margin, value, target, weight.

    A value of a margin without tokens, or that no target names, gets none. Cells without tokens keep the weight zero. The
    margin that a round sets last meets its targets; how far the others are from theirs is in the report.
    """
    cells = cut(cells)
    table = cut(union_all([_margin(cells, m, targets[m]) for m in MARGINS]))
    if cells.limit(FEW + 1).count() > FEW:
        table, fitted = _fit_many(cells, table, rounds)
    else:
        fitted = _fit_few(cells, table, rounds)
    sums = union_all([fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("weight").alias("weight")) for m in MARGINS])
    return fitted, table.join(sums, ["margin", "value"]).select("margin", "value", "target", "weight")


def _rates(measures: DataFrame, targets, rounds: int) -> DataFrame:
    """Rates by cell; marked for a broadcast if there are few of them."""
    cells = measures.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted, _ = fit(cells, targets, rounds)
    rate = F.round(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0), 6)
    rates = fitted.select(*MARGINS, rate.alias("rate"))
    return F.broadcast(rates) if rates.count() <= FEW else rates


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(documents: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``documents``: doc_id, source, lang, topic, n_tokens, rate, copies, kept.

    ``rate`` is the calibrated number of copies (below one: the probability to stay), rounded to six digits; ``copies``
    the drawn one, kept if it is not zero. Null names and texts are empty ones; texts without a word belong to cells that
    may have no tokens, and then go; rows that repeat an id share its draw; other columns are ignored.
    """
    measures = cut(measured(documents))
    rows = measures.join(_rates(measures, targets, rounds), list(MARGINS))
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select("doc_id", *MARGINS, "n_tokens", "rate", "copies", (F.col("copies") > 0).alias("kept"))


def keep_sampled(documents: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The rows of ``documents`` that are drawn at least once, with their columns."""
    rates = _rates(measured(documents), targets, rounds)
    prefix = "cell"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix += "_"
    names, rate, u = [f"{prefix}{m}" for m in MARGINS], f"{prefix}rate", f"{prefix}draw"
    renamed = rates.select(*(F.col(m).alias(x) for m, x in zip(MARGINS, names)), F.col("rate").alias(rate))
    text = text_of()
    own = [F.coalesce(F.col(m).cast("string"), F.lit("")) for m in MARGINS[:2]] + [topic(F.regexp_count(text, F.lit(WORD)), text)]
    marked = documents.withColumns(dict(zip(names, own)) | {u: draw(F.col("doc_id").cast("long"), seed)})
    joined = marked.join(renamed, names)
    return joined.where(F.col(u) < F.col(rate)).select(*documents.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    topic_sql = (
        "CASE WHEN 10 * (length(t) - length(translate(t, '#*$%&|<>', ''))) > n THEN 'symbols' WHEN n < 50 THEN 'short' "
        "WHEN 20 * (length(t) - length(replace(t, chr(10), '')) + 1) > n THEN 'lists' ELSE 'prose' END"
    )
    parts = [
        "m0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,"
        r" CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)",
        f"m AS (SELECT doc_id, source, lang, {topic_sql} AS topic, n AS n_tokens FROM m0)",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM m GROUP BY ALL)",
    ]
    for margin in MARGINS:
        parts.append(f"h_{margin} AS (SELECT {margin}, sum(tokens) AS has FROM c GROUP BY {margin})")
        power = float(TARGETS[margin])
        parts.append(
            f"t_{margin} AS (SELECT {margin}, pow(has, {power}) * (SELECT sum(has) FROM h_{margin})"
            f" / (SELECT sum(pow(has, {power})) FROM h_{margin}) AS t FROM h_{margin})"
        )
    parts.append(
        "w0 AS (SELECT c.*, tokens AS weight, a.t AS t_source, b.t AS t_lang, d.t AS t_topic FROM c"
        " JOIN t_source a ON a.source = c.source JOIN t_lang b ON b.lang = c.lang JOIN t_topic d ON d.topic = c.topic)"
    )
    step = 0
    for _ in range(ROUNDS):
        for margin in MARGINS:
            parts.append(
                f"w{step + 1} AS (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, CASE WHEN sum(weight) OVER (PARTITION BY {margin}) > 0"
                f" THEN weight * t_{margin} / sum(weight) OVER (PARTITION BY {margin}) ELSE weight END AS weight FROM w{step})"
            )
            step += 1
    parts.append(f"r AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END, 6) AS rate FROM w{step})")
    u = f"CAST(('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), ':{SEED}')), 1, 13)) AS BIGINT) / 4503599627370496.0"
    parts.append(f"x AS (SELECT m.*, r.rate, CAST(floor(rate) + CASE WHEN {u} < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM m JOIN r USING (source, lang, topic))")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, n_tokens, rate, copies, copies > 0 AS kept FROM x"


ORACLE = _oracle()
