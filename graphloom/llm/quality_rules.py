"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a row keeps its measurements and one long whose bit k says that rule k failed. A policy is
a mask of such bits, so a new version of it, or the question what one rule alone removes, reads the ledger and never the
texts. All of it is built-in expressions on single rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, table, text_of

#: Words in a window whose repetition counts.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurement columns) is true; null counts as passed."""

    name: str
    bit: int
    fails: str


#: Bits are never used again for another rule: old ledgers stay readable.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", 4, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("exclamations", 5, "10 * n_exclamations > 3 * n_words"),
    Rule("same_neighbours", 6, "n_words >= 10 AND 10 * n_same_neighbours > 3 * n_words"),
    Rule("few_letters", 7, "10 * n_letters < 6 * word_chars"),
)

BASE = frozenset({"few_words", "repeated_windows"})
#: Versioned policies: rule names whose failure removes a document.
POLICIES = {
    "base-1": BASE,
    "strict-1": BASE | {"symbols", "exclamations", "same_neighbours"},
    "strict-2": frozenset(r.name for r in RULES),
}
CURRENT = "strict-1"


def mask_of(policy: frozenset[str]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in policy)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, only its variables are not evaluated anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _letters_without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, each word once, exactly.

    Windows are hashed first: a text whose hashes are all different, as most are, has no repeated window. Only in the
    others are the windows themselves sorted, so that equal ones stand side by side.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(WINDOW))))

    def covered(order: Column) -> Column:
        def same(k: Column, step: int) -> Column:
            return F.coalesce(F.get(order, k + step)["w"] == F.get(order, k)["w"], F.lit(False))

        found = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: F.when(k > 0, same(k, -1)).otherwise(False) | same(k, 1))
        places = F.array_sort(F.transform(found, lambda k: F.get(order, k)["i"]))
        return _let(places, spans)

    def spans(places: Column) -> Column:
        def size(x: Column, k: Column) -> Column:
            return F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - x, F.lit(WINDOW)))

        return F.aggregate(F.transform(places, size), F.lit(0), lambda a, b: a + b)

    def windows(_: Column) -> Column:
        rows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))
        return _let(F.array_sort(rows), covered)

    slow = _let(F.lit(1), windows)
    return F.when(F.size(words) < WINDOW, 0).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(slow))
    )


def measurements(documents: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row's whole text (null: empty)."""
    text = F.col("t")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words = F.col("words")
    dense = F.translate(text, " \t\n\x0b\x0c\r", "")

    def neighbours(w: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.get(w, i) == F.get(w, i - 1)))

    return rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(dense).cast("long").alias("word_chars"),
        _letters_without(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(words, _repeated).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _letters_without(text, "!").cast("long").alias("n_exclamations"),
        F.when(F.size(words) < 2, 0).otherwise(_let(words, neighbours)).cast("long").alias("n_same_neighbours"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements and ``failed`` (bit k: rule k failed) of each row."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(documents).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` of ledger rows under a policy version, from the stored bits alone."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names)).cast("long")) != 0
    rows = rows.withColumn("base_failed", hit(BASE))
    return rows.withColumn("kept", ~F.col("base_failed") & ~hit(POLICIES[policy]))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that it alone removes, and that the rest of the policy removes.

    The ledger is reduced to counts per failure pattern (at most 2 to the number of rules) before anything is compared.
    """
    mask = mask_of(POLICIES[policy])
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    bits = [(r.name, 1 << r.bit) for r in RULES if r.name in POLICIES[policy]]
    tests = F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in bits)))
    each = patterns.select("p", "n", tests)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    p, bit = F.col("p"), F.col("bit")
    return each.groupBy("rule").agg(
        total(p.bitwiseAND(bit) != 0)("n_failed"),
        total(p == bit)("n_only"),
        total(p.bitwiseAND(F.bitwise_not(bit)) != 0)("n_removed_without"),
    )


def quality_rules(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger of all rows with the verdict of a policy.

    Null and empty texts have no words and fail ``few_words``; null ids stay null; repeated rows are judged alike; other
    columns are ignored; an empty table gives no rows.
    """
    return apply_policy(ledger(documents), policy)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    failed = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    hit = lambda names: f"(failed & {mask_of(names)}) <> 0"
    without = lambda c: f"length(t) - length(translate(t, '{c}', ''))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
 each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
 wins AS (SELECT doc_id, i, word = lag(word) OVER o AS same,
   word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS win
   FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins WHERE win IS NOT NULL) WHERE n > 1),
 covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
 same AS (SELECT doc_id, count(*) AS n FROM wins WHERE same GROUP BY doc_id),
 m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
   CAST({without("#*$%&|<>")} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
   coalesce(covered.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST({without("!")} AS BIGINT) AS n_exclamations,
   coalesce(same.n, 0) AS n_same_neighbours, CAST(length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS BIGINT) AS n_letters
   FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN same USING (doc_id)),
 f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m)
SELECT *, {hit(BASE)} AS base_failed, NOT ({hit(BASE)}) AND NOT ({hit(POLICIES[CURRENT])}) AS kept FROM f
"""


ORACLE = _oracle()


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does to ``documents``."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def _ablation_oracle() -> str:
    head = ORACLE[: ORACLE.rindex("SELECT *")]
    bits = ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES if r.name in POLICIES[CURRENT])
    total = lambda c: f"CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT)"
    return f"""{head}, p AS (SELECT failed & {mask_of(POLICIES[CURRENT])} AS p, count(*) AS n FROM f GROUP BY 1)
SELECT rule, {total("(p & bit) <> 0")} AS n_failed, {total("p = bit")} AS n_only, {total("(p & ~bit) <> 0")} AS n_removed_without
FROM p, (VALUES {bits}) b(rule, bit) GROUP BY rule
"""


ABLATION_ORACLE = _ablation_oracle()
