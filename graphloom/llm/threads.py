"""Quotation linking: which message a message answers, from what it quotes.

Lines with quote marks are parsed into passages (runs of lines of one quote level); a passage's normalised text is hashed
and looked up among the hashes of the messages, paragraphs and lines of its conversation, of which each keeps its earliest
turn, so no passage finds more than one original. A passage that is found nowhere as a whole may be an excerpt: if all its
paragraphs, or else all its lines, are found, its original is the turn by which the last of them was said. A message answers the original of its shallowest linked passage, else the
turn before it. Replies follow the message they answer, in the order of their turns: a preorder of the reply tree, found by
pointer jumping over the messages of branching conversations alone, in a number of rounds that is the logarithm of their
length. A conversation of any length is dealt out in blocks of turns; none is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, table, text_of

#: Turns of a conversation that are ordered in one group.
BLOCK = 4096
_MARKS = r"^(?:[ \t]*>)+"
#: What separates paragraphs.
_BLANK = r"\n[ \t\r]*\n"
#: A line that introduces a quotation.
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.*\b(?:wrote|writes|schrieb|a écrit|escribió))\s*:\s*$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _lines(text: Column) -> Column:
    """(level, body) of each line; the level of a line that introduces a quotation is -1."""

    def parsed(line: Column) -> Column:
        level = F.length(F.translate(F.regexp_extract(line, _MARKS, 0), " \t", ""))
        body = F.when(level > 0, F.regexp_replace(line, _MARKS + r"[ \t]?", "")).otherwise(line)
        return F.struct(level.alias("level"), body.alias("body"))

    def introduced(rows: Column) -> Column:
        def mark(row: Column, i: Column) -> Column:
            leads = (row["level"] == 0) & (F.coalesce(F.get(rows, i + 1)["level"], F.lit(0)) > 0) & row["body"].rlike(ATTRIBUTION)
            return F.struct(F.when(leads, -1).otherwise(row["level"]).alias("level"), row["body"].alias("body"))

        return F.transform(rows, mark)

    return _let(F.transform(F.split(text, "\r?\n", -1), parsed), introduced)


def _pieces(kind: int, texts: Column) -> Column:
    said = F.array_distinct(F.filter(F.transform(texts, normalise), lambda t: t != ""))
    return F.transform(said, lambda t: F.struct(F.lit(kind).alias("kind"), _digest(t).alias("hash")))


def _passages(rows: Column) -> Column:
    """(level, place, hash, pieces) of each run of lines of one quote level that has more than white space. Pieces, of runs of
    several lines, are the hashes of its paragraphs (kind 1) and lines (kind 2)."""
    level = lambda i: F.get(rows, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.when(i > 0, level(i) != level(i - 1)).otherwise(True))

    def runs(at: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(rows))
            bodies = F.transform(F.slice(rows, i + 1, end - i), lambda r: r["body"])
            text = normalise(F.array_join(bodies, " "))
            parts = F.concat(_pieces(1, F.split(F.array_join(bodies, "\n"), _BLANK, -1)), _pieces(2, bodies))
            pieces = F.when((end - i > 1) & (level(i) > 0), parts).otherwise(F.array().cast("array<struct<kind:int,hash:binary>>"))
            return F.struct(level(i).alias("level"), k.alias("place"), F.when(text != "", _digest(text)).alias("hash"), pieces.alias("pieces"))

        return F.filter(F.transform(at, run), lambda p: (p["level"] > 0) & p["hash"].isNotNull())

    return _let(starts, runs)


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotations, quoted (passages) and units (hashes by which others may quote it)."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_of().alias("whole"))
    quotes = F.col("whole").rlike(r"(?m)^(?:[ \t]*>)")
    rows = rows.withColumn("lines", F.when(quotes, _lines(F.col("whole"))))
    own = F.array_join(F.transform(F.filter("lines", lambda r: r["level"] == 0), lambda r: r["body"]), "\n")
    own = F.regexp_replace(own, r"^\s+|\s+$", "")
    rows = rows.withColumn("text", F.when(quotes, own).otherwise(F.col("whole")))
    text = F.col("text")
    units = F.concat(F.array(text), F.split(text, _BLANK, -1), F.split(text, "\n", -1))
    units = F.array_distinct(F.filter(F.transform(units, normalise), lambda u: u != ""))
    quoted = F.when(quotes, _let(F.col("lines"), _passages)).otherwise(F.array().cast("array<struct<level:int,place:int,hash:binary,pieces:array<struct<kind:int,hash:binary>>>>"))
    return rows.select("conv_id", "turn", "role", "text", quoted.alias("quoted"), F.transform(units, _digest).alias("units"))


def in_order(rows: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` (distinct in group and turn) with before, after (neighbouring turns of the group) and place (from 1).

    Windows hold a block of turns each; a second window goes over the blocks of a group.
    """
    rows = rows.withColumn("block", F.floor(F.col("turn") / block))
    inside, across = Window.partitionBy(*group, "block").orderBy("turn"), Window.partitionBy(*group).orderBy("block")
    blocks = rows.groupBy(*group, "block").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*group, "block", F.lag("high").over(across).alias("high"), F.lead("low").over(across).alias("low"), earlier.alias("earlier"))
    rows = rows.withColumn("before", F.lag("turn").over(inside)).withColumn("after", F.lead("turn").over(inside)).withColumn("place", F.row_number().over(inside))
    rows = rows.join(blocks, [*group, "block"])
    return (
        rows.withColumn("before", F.coalesce("before", "high"))
        .withColumn("after", F.coalesce("after", "low"))
        .withColumn("place", F.col("place") + F.col("earlier"))
        .drop("block", "low", "high", "earlier")
    )


def reply_order(tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """``tree`` (conv_id, turn, parent; one root a conversation) to conv_id, turn, reply_order: the preorder, from 1."""
    child = tree.where("parent IS NOT NULL").select("conv_id", "parent", "turn")
    nodes = tree.join(in_order(child, ["conv_id", "parent"], block).select("conv_id", "turn", F.col("after").alias("sibling")), ["conv_id", "turn"], "left")
    first = child.groupBy("conv_id", "parent").agg(F.min("turn").alias("child")).withColumnRenamed("parent", "turn")
    nodes = cut(nodes.join(first, ["conv_id", "turn"], "left"))
    # up: the nearest of a node and its ancestors that has a next sibling
    up = nodes.select("conv_id", "turn", F.when(F.col("sibling").isNotNull(), F.col("turn")).otherwise(F.col("parent")).alias("up"))
    while True:
        over = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        up = cut(up.join(over, ["conv_id", "up"], "left").select("conv_id", "turn", F.col("next").alias("up"), (F.col("up").isNotNull() & ~F.col("next").eqNullSafe(F.col("up"))).alias("moved")))
        going = up.where("moved").limit(1).count()
        up = up.drop("moved")
        if not going:
            break
    over = nodes.select("conv_id", F.col("turn").alias("up"), F.col("sibling").alias("over"))
    next_ = nodes.select("conv_id", "turn", "child").join(up, ["conv_id", "turn"]).join(over, ["conv_id", "up"], "left")
    rank = cut(next_.select("conv_id", "turn", F.coalesce("child", "over").alias("next"), F.lit(1).cast("long").alias("rank")))
    while rank.where("next IS NOT NULL").limit(1).count():
        ahead = rank.select("conv_id", F.col("turn").alias("next"), F.col("next").alias("next2"), F.col("rank").alias("rank2"))
        rank = rank.join(ahead, ["conv_id", "next"], "left")
        rank = cut(rank.select("conv_id", "turn", F.col("next2").alias("next"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank")))
    total = rank.groupBy("conv_id").agg(F.max("rank").alias("total"))
    return rank.join(total, "conv_id").select("conv_id", "turn", (F.col("total") - F.col("rank") + 1).alias("reply_order"))


def _excerpts(known: DataFrame, whole: DataFrame, originals: DataFrame, passage: list[str]) -> DataFrame:
    """passage, original of those that are not found as a whole, by their paragraphs or lines."""
    each = known.select("conv_id", "turn", F.explode("quoted").alias("q")).where(F.size("q.pieces") > 0)
    each = each.select("conv_id", "turn", "q.level", "q.place", "q.hash", F.explode("q.pieces").alias("p")).select(*passage, "p.kind", F.col("p.hash").alias("piece")).distinct()
    each = each.join(whole.select(*passage), passage, "left_anti")
    found = each.join(originals.withColumnRenamed("hash", "piece"), ["conv_id", "piece"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    kinds = found.groupBy(*passage, "kind").agg(F.max("original").alias("original"), F.count("original").alias("n"), F.count(F.lit(1)).alias("of")).where("n = of")
    return kinds.groupBy(*passage).agg(F.min_by("original", "kind").alias("original"))


def link_quotations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, text (without quotations),
    parent_turn, reply_order, n_quoted, n_linked.

    parent_turn is the turn that the message answers (null for a conversation's first), reply_order its place in the
    conversation when replies follow what they answer. Rows of one conversation and turn share both. A null text is empty;
    rows with a null conversation or turn are not linked: parent_turn and reply_order are null. Other columns are ignored.
    """
    rows = cut(parse(messages))
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.place", "q.hash").distinct()
    originals = known.select("conv_id", F.explode("units").alias("hash"), "turn").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    passage = ["conv_id", "turn", "level", "place", "hash"]
    whole = quoted.join(originals, ["conv_id", "hash"]).where("original < turn").select(*passage, "original")
    links = cut(whole.unionByName(_excerpts(known, whole, originals, passage)))
    chosen = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "place", "original")).alias("best"), F.count(F.lit(1)).alias("n_linked"))

    turns = in_order(known.select("conv_id", "turn").distinct(), ["conv_id"], block).drop("after")
    turns = turns.join(chosen, ["conv_id", "turn"], "left")
    parent = F.coalesce(F.col("best.original"), F.col("before"))
    turns = cut(turns.select("conv_id", "turn", "before", "place", parent.alias("parent"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked")))
    branching = turns.where("parent <> before").select("conv_id").distinct()
    if branching.limit(1).count():
        branching = cut(branching)
        order = reply_order(turns.join(branching, "conv_id", "left_semi").select("conv_id", "turn", "parent"), block)
        turns = turns.join(order, ["conv_id", "turn"], "left")
    else:
        turns = turns.withColumn("reply_order", F.lit(None).cast("long"))
    turns = turns.select("conv_id", "turn", F.col("parent").alias("parent_turn"), F.coalesce("reply_order", F.col("place").cast("long")).alias("reply_order"), "n_linked")
    out = rows.join(turns, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "reply_order", F.size("quoted").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def op4_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS whole, row_number() OVER () AS rid FROM conversations),
 lines AS (SELECT rid, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT rid, string_split_regex(whole, '\r?\n') AS ls FROM m WHERE regexp_matches(whole, '(^|\n)[ \t]*>'))),
 marked AS (SELECT rid, i, line, length(replace(replace(regexp_extract(line, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) AS level FROM lines),
 bodies AS (SELECT rid, i, level, CASE WHEN level > 0 THEN regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') ELSE line END AS body FROM marked),
 levels AS (SELECT rid, i, body, CASE WHEN level = 0 AND coalesce(lead(level) OVER o, 0) > 0 AND regexp_matches(body, '{ATTRIBUTION}') THEN -1 ELSE level END AS level
   FROM bodies WINDOW o AS (PARTITION BY rid ORDER BY i)),
 turns_of AS (SELECT rid, i, body, level, CASE WHEN lag(level) OVER o = level THEN 0 ELSE 1 END AS fresh FROM levels WINDOW o AS (PARTITION BY rid ORDER BY i)),
 numbered AS (SELECT rid, i, body, level, sum(fresh) OVER (PARTITION BY rid ORDER BY i) - 1 AS place FROM turns_of),
 passages AS (SELECT rid, place, level, trim(lower(regexp_replace(string_agg(body, ' ' ORDER BY i), '\s+', ' ', 'g'))) AS said, string_agg(body, chr(10) ORDER BY i) AS raw FROM numbered WHERE level > 0 GROUP BY rid, place, level),
 quoted AS (SELECT * FROM passages WHERE said <> ''),
 own AS (SELECT rid, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS own FROM numbered GROUP BY rid),
 rows_ AS (SELECT m.rid, conv_id, turn, role, coalesce(own.own, whole) AS text FROM m LEFT JOIN own USING (rid)),
 units AS (SELECT conv_id, turn, trim(lower(regexp_replace(unnest(list_concat(list_concat([text], string_split_regex(text, '\n[ \t\r]*\n')), string_split(text, chr(10)))), '\s+', ' ', 'g'))) AS said
   FROM rows_ WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 originals AS (SELECT conv_id, said, min(turn) AS original FROM units WHERE said <> '' GROUP BY conv_id, said),
 whole_ AS (SELECT DISTINCT r.conv_id, r.turn, q.level, q.place, q.said, o.original FROM quoted q JOIN rows_ r USING (rid)
   JOIN originals o ON o.conv_id = r.conv_id AND o.said = q.said WHERE o.original < r.turn),
 pieces AS (SELECT DISTINCT r.conv_id, r.turn, level, place, said, kind, trim(lower(regexp_replace(piece, '\s+', ' ', 'g'))) AS piece FROM (
   SELECT rid, level, place, said, 1 AS kind, unnest(string_split_regex(raw, '\n[ \t\r]*\n')) AS piece FROM quoted WHERE contains(raw, chr(10))
   UNION ALL SELECT rid, level, place, said, 2, unnest(string_split(raw, chr(10))) FROM quoted WHERE contains(raw, chr(10))) JOIN rows_ r USING (rid)),
 excerpts AS (SELECT conv_id, turn, level, place, said, arg_min(original, kind) AS original FROM (
   SELECT p.conv_id, p.turn, p.level, p.place, p.said, kind, max(o.original) AS original FROM (SELECT * FROM pieces WHERE piece <> '') p
   LEFT JOIN originals o ON o.conv_id = p.conv_id AND o.said = p.piece AND o.original < p.turn
   WHERE NOT EXISTS (SELECT 1 FROM whole_ w WHERE w.conv_id = p.conv_id AND w.turn = p.turn AND w.level = p.level AND w.place = p.place AND w.said = p.said)
   GROUP BY ALL HAVING count(o.original) = count(*)) GROUP BY ALL),
 links AS (SELECT * FROM whole_ UNION ALL SELECT * FROM excerpts),
 best AS (SELECT conv_id, turn, original, n_linked FROM (SELECT conv_id, turn, original, CAST(count(*) OVER (PARTITION BY conv_id, turn) AS INTEGER) AS n_linked,
   row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, place, original) AS k FROM links) WHERE k = 1),
 keys AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM rows_ WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
 tree AS (SELECT k.conv_id, k.turn, coalesce(original, before) AS parent_turn, coalesce(n_linked, 0) AS n_linked FROM keys k LEFT JOIN best b ON b.conv_id = k.conv_id AND b.turn = k.turn),
 walk AS (SELECT conv_id, turn, [turn] AS path FROM tree WHERE parent_turn IS NULL
   UNION ALL SELECT t.conv_id, t.turn, list_append(w.path, t.turn) FROM tree t JOIN walk w ON w.conv_id = t.conv_id AND w.turn = t.parent_turn),
 placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS reply_order FROM walk),
 counted AS (SELECT rid, CAST(count(*) AS INTEGER) AS n_quoted FROM quoted GROUP BY rid)
SELECT r.conv_id, r.turn, r.role, r.text, t.parent_turn, p.reply_order, coalesce(c.n_quoted, 0) AS n_quoted, coalesce(t.n_linked, 0) AS n_linked
FROM rows_ r LEFT JOIN tree t ON t.conv_id = r.conv_id AND t.turn = r.turn LEFT JOIN placed p ON p.conv_id = r.conv_id AND p.turn = r.turn LEFT JOIN counted c USING (rid)
"""
