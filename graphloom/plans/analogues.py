"""Stand-ins for code relations, derived from the supplied tables, which hold no source code.

Each view has a DataFrame form and the same derivation as an SQL common table expression, so that an operator can run on
it and be compared with independent SQL.

- findings, functions: ``part``; the size is the complexity, the brand the file.
- changes (commit files): ``lineitem``; order, part and supplier are commit, file and author.
- modules, chunks: ``documents``.
- edges: ``lineitem``, supplier to part modulo 100.
- members (of classes): ``lineitem``; order, line number and supplier modulo 5 are class, method and attribute.
- days (of a trend): ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import severity
from graphloom.tables import table

RULE_IDS = ("complexity/high-cyclomatic-complexity", "design/god-object", "dead-code/unused-import", "security/weak-hash")


def findings(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(
        F.lit("").alias("snapshot"),
        F.element_at(F.array(*map(F.lit, RULE_IDS)), (size % 4 + 1).cast("int")).alias("rule_id"),
        F.concat(F.lit("src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("/")), F.lit(".py")).alias("path"),
        F.when(key % 97 != 0, (key % 97).cast("int")).alias("line"),
        F.when(key % 10 != 0, F.concat_ws(" ", "p_name", key.cast("string"))).alias("symbol"),
        severity.scaled(size, 10, 15, 20).cast("int").alias("severity"),
        (size % 4).cast("int").alias("rule_ordinal"),
        key.alias("src_ordinal"),
    ).withColumn("category", F.split_part("rule_id", F.lit("/"), F.lit(1)))


FINDINGS = f"""findings AS (
  SELECT CASE p_size % 4 WHEN 0 THEN '{RULE_IDS[0]}' WHEN 1 THEN '{RULE_IDS[1]}' WHEN 2 THEN '{RULE_IDS[2]}' ELSE '{RULE_IDS[3]}' END AS rule_id,
         'src/' || replace(lower(p_brand), '#', '/') || '.py' AS path,
         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_partkey % 97 AS INTEGER) END AS line,
         CASE WHEN p_partkey % 10 <> 0 THEN p_name || ' ' || CAST(p_partkey AS VARCHAR) END AS symbol,
         CASE WHEN p_size >= 20 THEN 4 WHEN p_size >= 15 THEN 3 WHEN p_size >= 10 THEN 2 ELSE 1 END AS severity,
         CAST(p_size % 4 AS INTEGER) AS rule_ordinal, p_partkey AS src_ordinal,
         CASE p_size % 4 WHEN 0 THEN 'complexity' WHEN 1 THEN 'design' WHEN 2 THEN 'dead-code' ELSE 'security' END AS category
  FROM part)"""


def functions(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(
        F.lit("").alias("snapshot"),
        F.col("p_brand").alias("path"),
        key.cast("string").alias("qualname"),
        F.col("p_name").alias("name"),
        size.alias("cyclomatic"),
        size.alias("cognitive"),
        (key % 250).cast("int").alias("length"),
        (key % 12).cast("int").alias("parameters"),
        (size % 8).cast("int").alias("nesting"),
        key.alias("ordinal"),
        (key % 500 + 1).cast("int").alias("lineno"),
    )


FUNCTIONS = """functions AS (
  SELECT p_brand AS path, CAST(p_partkey AS VARCHAR) AS qualname, p_name AS name, p_size AS cyclomatic, p_size AS cognitive,
         CAST(p_partkey % 250 AS INTEGER) AS length, CAST(p_partkey % 12 AS INTEGER) AS parameters,
         CAST(p_size % 8 AS INTEGER) AS nesting, p_partkey AS ordinal, CAST(p_partkey % 500 + 1 AS INTEGER) AS lineno
  FROM part)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sha"),
        F.col("l_partkey").cast("string").alias("path"),
        F.col("l_suppkey").alias("author"),
        F.col("l_quantity").cast("long").alias("insertions"),
        F.col("l_linenumber").cast("long").alias("deletions"),
        F.col("l_shipdate").alias("committed_at"),
    )


HISTORY = """history AS (
  SELECT CAST(l_partkey AS VARCHAR) AS path, count(*) AS commits, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS insertions,
         CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS deletions, count(DISTINCT l_suppkey) AS authors,
         max(l_shipdate) AS last_modified,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS churn
  FROM lineitem GROUP BY l_partkey)"""


def modules(spark: SparkSession, d: str) -> DataFrame:
    rel_path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").select("doc_id", rel_path.alias("rel_path"), (F.col("n_chars") / 10).cast("int").alias("loc"), "text", "source", "lang")


MODULES = """modules AS (
  SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.py' AS rel_path,
         CAST(floor(n_chars / 10.0) AS INTEGER) AS loc, text, source, lang FROM documents)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.lit("").alias("snapshot"), F.col("l_suppkey").cast("string").alias("src"), (F.col("l_partkey") % 100).cast("string").alias("dst"))
    return rows.where("src <> dst").distinct()


EDGES = """edges AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % 100 AS VARCHAR) AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 100)"""


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers: some of them without an edge."""
    return table(spark, d, "supplier").select(F.lit("").alias("snapshot"), F.col("s_suppkey").cast("string").alias("name"))


#: All ends of edges besides the suppliers.
VERTICES = """vertices AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS name FROM supplier UNION SELECT src FROM edges UNION SELECT dst FROM edges)"""


def all_vertices(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    ends = e.select("snapshot", F.col("src").alias("name")).unionByName(e.select("snapshot", F.col("dst").alias("name")))
    return vertices(spark, d).unionByName(ends).distinct()


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("method"), (F.col("l_suppkey") % 5).alias("attribute"))


MEMBERS = """members AS (
  SELECT DISTINCT l_orderkey AS owner, l_linenumber AS method, l_suppkey % 5 AS attribute FROM lineitem)"""

#: Groups of methods of each class: methods that share an attribute, followed to the end.
GROUPS = (
    MEMBERS
    + """, links AS (SELECT DISTINCT a.owner, a.method AS m, b.method AS n FROM members a JOIN members b USING (owner, attribute)),
 reach AS (SELECT owner, m, n FROM links UNION SELECT r.owner, r.m, l.n FROM reach r JOIN links l ON l.owner = r.owner AND l.m = r.n),
 groups AS (SELECT owner, CAST(count(DISTINCT least_n) AS INTEGER) AS lcom FROM (SELECT owner, m, min(n) AS least_n FROM reach GROUP BY owner, m) GROUP BY owner)"""
)


def days(spark: SparkSession, d: str) -> DataFrame:
    """A sample a day: score of its events as findings, newest first from position 0."""
    level = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(0)
    rows = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), level.alias("severity"), "user_id")
    counted = rows.groupBy("day").agg(
        *(F.count_if(F.col("severity") == k).alias(name) for k, name in enumerate(severity.LABELS)),
        (F.countDistinct("user_id") * 10_000).alias("loc"),
    )
    return counted


DAYS = """counted AS (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type IN ('view', 'click')) AS info, CAST(0 AS BIGINT) AS low,
         count(*) FILTER (event_type = 'signup') AS medium, count(*) FILTER (event_type = 'purchase') AS high,
         count(*) FILTER (event_type = 'error') AS critical, count(DISTINCT user_id) * 10000 AS loc
  FROM events GROUP BY 1),
 days0 AS (SELECT *, info * 0.1::DOUBLE + low * 0.5::DOUBLE + medium * 1.5::DOUBLE + high * 4.0::DOUBLE + critical * 8.0::DOUBLE AS p FROM counted),
 days AS (SELECT *, p / greatest(1.0::DOUBLE, loc / 100.0::DOUBLE) AS dens FROM days0)"""

#: Score, from a table with a density ``dens``.
SCORE = "CAST(round_even(greatest(0.0, least(100.0, 100 - 10 * dens)), 0) AS INTEGER)"
GRADE = "CASE WHEN dens < 1 THEN 'A' WHEN dens < 2 THEN 'B' WHEN dens < 4 THEN 'C' WHEN dens < 7 THEN 'D' ELSE 'F' END"
PENALTY = "(info * 0.1::DOUBLE + low * 0.5::DOUBLE + medium * 1.5::DOUBLE + high * 4.0::DOUBLE + critical * 8.0::DOUBLE)"
COUNTS = ", ".join(f"count(*) FILTER (severity = {k}) AS {name}" for k, name in enumerate(severity.LABELS))
LABEL = "CASE severity WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"
STOP = "('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')"


def tokens_sql(body: str) -> str:
    """The code tokens of a text expression as a list."""
    parts = rf"list_transform(regexp_extract_all({body}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: string_split(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_'))"
    return f"list_filter(flatten({parts}), lambda t: length(t) > 1 AND t NOT IN {STOP})"
