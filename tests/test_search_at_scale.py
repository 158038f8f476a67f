"""Search and secrets: what is read, shuffled or searched once, against plain forms of it."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import index, search
from graphloom.plans import catalogue


def plain_tokens(body):
    marked = re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", body)
    return [t for t in map(str.lower, re.findall("(?<=_)[0-9][A-Za-z0-9]+|[A-Za-z][A-Za-z0-9]+", marked)) if t not in text.STOPWORDS]


def texts(n=400):
    rng = random.Random(3)
    return ["".join(rng.choice("abzABZ019__ .é\n") for _ in range(rng.randrange(40))) for _ in range(n)] + ["parseHTTPResponse the theThe x1Y2 _9Ab __9 9abc _12ab_3C"]


def test_tokens_in_one_pass(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "k int, t string").select("t", text.tokens(F.col("t")).alias("x"))
    assert all(r.x == plain_tokens(r.t) for r in rows.collect())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0


def test_token_counts(spark):
    bodies = [*texts(60), "", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, t string").select("k", search.token_counts(text.tokens(F.col("t"))).alias("x"))
    for r in rows.collect():
        assert {e.token: e.tf for e in r.x or ()} == Counter(plain_tokens(bodies[r.k] or "")) and len(r.x or ()) == len({e.token for e in r.x or ()})


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **b: (plans.append(explained(self._df)), write(self, *a, **b))[1])
    search.save_tokens(spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "id long, text string"), str(tmp_path / "i"), "id")
    assert plans[0].count("Exchange") == 1 and "Aggregate" not in plans[0]
    found = search.find_tokens(spark, str(tmp_path / "i"), ["aa", "bb", "bb"], "id")
    wanted = search.bm25(spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "id long, text string"), ["aa", "bb", "bb"])
    assert {r.id: r.score for r in found.collect()} == {r.id: r.score for r in wanted.collect()}


def test_ranked_texts_are_tokenised_once(spark, sf_dir):
    plan = explained(catalogue.QUERIES["bm25_topk"](spark, sf_dir))
    assert "regexp_extract_all" not in plan
    chunks = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    for query in (["ab", "b1", "ab"], ["zz"], []):
        keys = search.bm25_keys(chunks, query, "id")
        assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, search.bm25(chunks, query).select("id", "raw", "score").collect()))


def test_an_index_groups_ids_only(spark):
    row = lambda i, path, n, body: (i, "module", path, "s", 1, 1, body, body, n)
    schema = "chunk_id string, kind string, path string, symbol string, lineno int, end_lineno int, text string, content_hash string, ordinal int"
    once = spark.createDataFrame([row("a", "p", 0, "x"), row("b", "p", 1, "y")], schema)
    assert "Exchange" not in explained(index._last(once)) and index._last(once).count() == 2
    twice = once.union(spark.createDataFrame([row("a", "q", 0, "later"), row("a", "p", 7, "z")], schema))
    assert {(r.chunk_id, r.text) for r in index._last(twice).collect()} == {("a", "later"), ("b", "y")}


def test_secrets_are_searched_once(spark, sf_dir, tmp_path):
    assert "regexp_extract_all" not in explained(catalogue.QUERIES["secret_scan"](spark, sf_dir))
    made = ['tokentoken_x  =  "12345678"', 'my_password="a\nb c d e f"', 'secret = "1234567', 'secret = "1234567"', 'token x = "123456789"', 'TOKEN = "123456789"', 'é_secret_ = "123456789" token="abcdefghi"']
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.name, r.value_length) for r in catalogue.QUERIES["secret_scan"](spark, str(tmp_path)).collect()}
    assert found == {(0, "tokentoken_x", 8), (1, "my_password", 11), (6, "_secret_", 9), (6, "token", 9)}
