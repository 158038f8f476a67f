import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import chunks, findings, graphs, history, index, parse, resolve, scoring, search, trend


def modules(spark, files, root="root"):
    return parse.parse_sources(spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "rel_path string, content binary"), root)


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_import_graph(spark):
    m = modules(
        spark,
        {
            "src/pkg/__init__.py": "from . import a\nfrom .sub.deep import x\n",
            "src/pkg/a.py": "import os.path\nimport pkg.b\nfrom pkg import b\nfrom pkg.b.name import y\n",
            "src/pkg/b.py": "from .a import f\nfrom .. import nothing\nimport collections as c, json\n",
            "src/pkg/sub/__init__.py": "",
            "src/pkg/sub/deep.py": "from ..b import g\nfrom . import deep\nfrom . import *\nimport pkg.sub.deep\n",
            "src/alone.py": "",
        },
    )
    edges, externals = resolve.import_graph(m)
    assert pairs(edges, "src", "dst") == [("pkg", "pkg.a"), ("pkg", "pkg.sub.deep"), ("pkg.a", "pkg"), ("pkg.a", "pkg.b"), ("pkg.b", "pkg.a"), ("pkg.sub.deep", "pkg.b"), ("pkg.sub.deep", "pkg.sub")]
    assert pairs(externals, "package", "n") == [("collections", 1), ("json", 1), ("nothing", 1), ("os", 1)]
    names = m.select("snapshot", F.col("module_name").alias("name"))
    degrees = {r.name: (r.fan_in, r.fan_out) for r in graphs.degrees(names, edges).collect()}
    assert degrees["alone"] == (0, 0) and degrees["pkg.a"] == (2, 2) and degrees["pkg.sub.deep"] == (1, 2)


def test_call_graph(spark):
    m = modules(
        spark,
        {
            "m.py": "from .other import far as near\nimport other\nclass Service:\n    def run(self):\n        self.step()\n        self.missing()\n        near()\n    def step(self):\n        Service().run()\n        other.far()\n        int(1)\ndef helper():\n    helper()\n    Service.step(1)\n    Service.none()\n    near.more()\n",
            "other.py": "def far():\n    from m import helper\n    helper()\n    m.helper()\n",
            "twice.py": "def f():\n    pass\ndef f():\n    g()\ndef g():\n    f()\n",
        },
    )
    _, edges = resolve.call_graph(m)
    assert pairs(edges, "caller", "callee") == [
        ("m.Service.run", "m.Service.step"), ("m.Service.run", "other.far"), ("m.Service.step", "m.Service.run"), ("m.Service.step", "other.far"),
        ("m.helper", "m.Service.step"), ("m.helper", "other.far"), ("twice.f", "twice.g"), ("twice.g", "twice.f"),
    ]


def components(edges):
    reach = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            for x, y in edges:
                if x == todo[0] and y not in seen:
                    seen.add(y)
                    todo.append(y)
            todo.pop(0)
        reach[a] = seen
    groups = {a: min({a} | {b for b in reach[a] if a in reach.get(b, ())}) for a in reach}
    return sorted((a, g) for a, g in groups.items() if sum(x == g for x in groups.values()) > 1)


@pytest.mark.parametrize("local", [graphs.LOCAL_EDGES, 0])
def test_cycles(spark, local):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(17)} | {("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("t", "a")}
    edges = {(a, b) for a, b in edges if a != b}
    frame = spark.createDataFrame([("", a, b) for a, b in edges] + [("s2", "a", "b")], "snapshot string, src string, dst string")
    found = graphs.cyclic_components(frame, local)
    assert pairs(found, "name", "component") == components(edges)
    assert found.where("snapshot = 's2'").count() == 0


def test_history(spark):
    rows = [("a", "x", 1, 0, "2024-01-02"), ("a", "y", 2, 3, "2024-01-01"), ("b", "x", 0, 0, "2024-01-03"), ("c", "z", 9, 9, "2024-01-01")]
    h = history.file_history(spark.createDataFrame(rows, "path string, author string, insertions int, deletions int, committed_at string"))
    assert pairs(h, "path", "commits", "churn", "authors", "last_modified") == [("a", 2, 6, 2, "2024-01-02"), ("b", 1, 0, 1, "2024-01-03"), ("c", 1, 18, 1, "2024-01-01")]
    assert [r.path for r in history.hotspots(h, 2).collect()] == ["c", "a"] and history.churn_percentile(h, 0.75).first().value == 1.5
    assert history.heat(h.where("path = 'b'")).count() == 0 and history.churn_percentile(h.limit(0), 0.5).first().value == 0
    assert [r.path for r in history.top_churn(h, 5).collect()] == ["a", "c", "b"]
    functions = spark.createDataFrame([("a", "a.f", 12), ("a", "a.g", 20), ("a", "a.low", 3), ("c", "c.f", 30)], "path string, qualname string, cyclomatic int")
    churn = spark.createDataFrame([("a", "a.f", 1, 1, 5, "d")], "path string, qualname string, commits long, authors long, lines int, last_modified string")
    hot = history.hot_functions(functions, h, churn, 2, 10, 15)
    assert pairs(hot, "qualname", "scope", "level") == [("a.g", "file", 3)]


@pytest.mark.parametrize(
    "counts, loc, penalty, density, score, grade",
    [
        ((7, 43, 38, 71, 0), 8029, 320.5, 3.99, 60, "C"),
        ((7, 28, 85, 92, 0), 10740, 341.5, 3.18, 68, "C"),
        ((13, 39, 66, 103, 0), 5901, 410.5, 6.96, 30, "D"),
        ((74, 158, 273, 381, 0), 118690, 1824.0, 1.54, 85, "B"),
        ((1, 2, 5, 3, 0), 211, 25.0, 11.85, 0, "F"),
        ((0, 0, 0, 0, 0), 0, 0.0, 0.0, 100, "A"),
    ],
)
def test_score(spark, counts, loc, penalty, density, score, grade):
    levels = [(4 - k,) for k, n in enumerate(counts) for _ in range(n)]
    r = scoring.health_score(spark.createDataFrame(levels, "severity int"), spark.createDataFrame([(loc,)], "loc int")).first()
    assert (r.penalty, r.density, r.score, r.grade) == (penalty, density, score, grade)


def test_ranks_are_global(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    ranked = findings.ranked(frame, [F.desc("a"), F.col("b")])
    assert [(r.a, r.b) for r in ranked.orderBy("rank").collect()] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 501))


@pytest.mark.parametrize(
    "path, glob, hit",
    [
        ("a/migrations/x.py", "migrations", True), ("a/b.py", "a", True), ("a/b.py", "/a/", True), ("ab/c.py", "a", False), ("x/y_pb2.py", "*_pb2.py", True),
        ("a/b/c.py", "a/*.py", True), ("a/b.py", "", False), ("a/b.py", "b.p?", True), ("a/b.py", "[!a].py", True), ("a/a.py", "[!a].py", False), ("a.b/c", "a.b", True),
        ("axb/c", "a.b", False), ("x/[1].py", "[[]1].py", True), ("pkg/sub/m.py", "pkg/sub", True),
    ],
)
def test_globs(spark, path, glob, hit):
    assert spark.range(1).select(paths.matches_glob(F.lit(path), glob).alias("x")).first().x is hit
    assert paths.matches_text(path, [glob]) is hit


def test_text(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("parseHTTPResponse snake_case_x the of x1 été __init__")).alias("tokens"),
        text.shorten_path(F.lit("a/very/long/path/name.py"), 15).alias("tail"),
        text.preview(F.lit("\n  \n  first \nsecond")).alias("preview"),
        text.fingerprint(F.lit("r"), F.lit("p"), F.lit(None)).alias("print"),
    ).first()
    assert row.tokens == ["parse", "httpresponse", "snake", "case", "x1", "init"] and row.tail == ".../name.py" and row.preview == "first"
    assert row.print == __import__("hashlib").sha1(b"r\0p\0").hexdigest()


def test_suppression_and_baseline(spark):
    rows = [("r1", "a/x.py", "s", 1), ("r1", "b/x.py", None, 2), ("r2", "a/x.py", "s", 3), ("r1", "a/x.py", "s", 4)]
    f = spark.createDataFrame(rows, "rule_id string, path string, symbol string, n int")
    kept, hidden = findings.split_suppressed(f, ["r1@a/*", "r3"])
    assert pairs(kept, "n") == [(2,), (3,)] and pairs(hidden, "n") == [(1,), (4,)]
    new, known = findings.split_baseline(f, findings.with_fingerprint(f.where("n = 1")))
    assert pairs(new, "n") == [(2,), (3,)] and pairs(known, "n") == [(1,), (4,)]
    assert findings.unknown_rules(["r1@a", "zz", "aa@x"], ["r1"]) == ["aa", "zz"]


def test_search(spark, tmp_path):
    m = modules(spark, {"pkg/a.py": '"""Parse."""\n\n\ndef parse_token(text):\n    return text.split()\n\n\nclass Reader:\n    def read(self):\n        return parse_token(self.text)\n', "pkg/b.py": "x = 1\n", "pkg/broken.py": "def (", "pkg/empty.py": "\n\n"})
    c = chunks.chunks(m)
    assert pairs(c, "kind", "symbol", "lineno", "end_lineno") == [("class", "pkg.a.Reader", 8, 10), ("function", "pkg.a.parse_token", 4, 5), ("method", "pkg.a.Reader.read", 9, 10), ("module", "pkg.a", 1, 10), ("module", "pkg.b", 1, 1)]
    hits = search.top_hits(search.bm25(c, search.query_tokens(spark, "parseToken"), symbol="symbol"), 3)
    assert hits.first().symbol == "pkg.a.parse_token" and search.bm25(c, []).count() == 0
    embedder, folder = search.HashEmbedder(32), str(tmp_path / "index")
    first = index.build(c, folder, embedder)
    assert (first.total, first.embedded, first.reused, first.removed) == (5, 5, 0, 0)
    assert index.find(spark, folder, "def parse_token(text): return text.split()", embedder, 1, 0.1).first().symbol == "pkg.a.parse_token"
    changed = c.where("symbol <> 'pkg.b'").withColumn("content_hash", F.when(F.col("kind") == "class", "new").otherwise(F.col("content_hash")))
    second = index.build(changed, folder, embedder)
    assert (second.total, second.embedded, second.reused, second.removed) == (4, 1, 3, 2)
    again = index.build(changed, folder, embedder)
    assert (again.embedded, again.reused, again.removed) == (0, 4, 0)
    assert index.build(changed, folder, embedder, rebuild=True).embedded == 4
    with pytest.raises(index.IndexUnavailable):
        index.load(spark, folder, "another model")
    assert index.build(changed, folder, search.HashEmbedder(16)).reused == 0


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, v array<float>")
    assert [(r.id, r.score) for r in search.cosine_hits(v, "v", [2.0, 1.0], 5, 0.0, ("id",)).collect()] == [("a", 0.8944), ("b", 0.4472)]
    assert search.cosine_hits(v, "v", [1.0, 0.0], 5, 1.0, ("id",)).count() == 0 and search.cosine_hits(v, "v", [0.0, 0.0], 5, -1.0, ("id",)).count() == 0
    unit = {r.id: r.u for r in v.select("id", search.normalised(F.col("v")).alias("u")).collect()}
    assert unit == {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0]}


def test_trend_summary(spark):
    days = spark.createDataFrame([(k, [70, 90, 90, 40, 60][k]) for k in range(5)], "day int, score int")
    r = trend.summary(days, "day").first()
    assert (r.delta, r.samples, r.best, r.worst) == (-10, 5, 1, 3)
    assert pairs(trend.samples_of(days, "day", 3), "day") == [(0,), (2,), (4,)]
    assert trend.summary(days.limit(1), "day").first().delta == 0
