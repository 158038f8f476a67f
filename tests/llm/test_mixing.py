import duckdb
import pytest
from pyspark.sql import functions as F

from cases import collected, edge_rows, frame
from graphloom.llm import mixing as M


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert collected(M.op8_mixing(spark, sf_dir)) == sorted(map(tuple, con.sql(M.ORACLE).fetchall()), key=repr)


def test_fitted_margins_meet_their_targets(spark):
    rows = [(s, g, t, 10 * (3 + i * j + k)) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame([*rows, ("a", "x", "r", 0)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1.0, "b": 2.0, "c": 1.0, "never": 5.0}, "lang": 0.5, "topic": {"p": 0.9, "q": 0.1}}
    fitted, report = M.fit(cells, targets, 40)
    total = sum(r[3] for r in rows)
    sums = lambda c: {r[0]: r[1] / total for r in fitted.groupBy(c).agg(F.sum("weight")).collect()}
    assert fitted.count() == 13 and sums("source") == pytest.approx({"a": 0.25, "b": 0.5, "c": 0.25})
    assert sums("topic") == pytest.approx({"p": 0.9, "q": 0.1, "r": 0.0})
    has = {g: sum(r[3] for r in rows if r[1] == g) ** 0.5 for g in "xy"}
    assert sums("lang") == pytest.approx({g: v / sum(has.values()) for g, v in has.items()})


def test_the_report_says_what_is_left(spark, sf_dir):
    """Few rounds come near: the last margin is met, the others by less than a hundredth of all tokens."""
    measures = M.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fitted, report = M.fit(measures.groupBy(*M.MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    rows = report.collect()
    total = sum(r.target for r in rows if r.margin == "topic")
    assert {r.margin for r in rows} == set(M.MARGINS)
    assert all(abs(r.weight - r.target) < (1e-9 if r.margin == "topic" else 1e-2) * total for r in rows)


def test_many_cells_take_the_other_way(spark, monkeypatch):
    cells = M.measured(frame(spark)).groupBy(*M.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    few = [collected(x) for x in M.fit(cells, rounds=2)]
    monkeypatch.setattr(M, "FEW", 0)
    for one, other in zip(few, (collected(x) for x in M.fit(cells, rounds=2))):
        assert [r[:-1] for r in one] == [r[:-1] for r in other] and [r[-1] for r in one] == pytest.approx([r[-1] for r in other])
    assert collected(M.mix(frame(spark), rounds=1))


def test_kept_rows(spark):
    kept, rows = M.keep_sampled(frame(spark)), {r.doc_id for r in M.mix(frame(spark)).where("kept").collect()}
    assert kept.columns == frame(spark).columns
    assert collected(kept) == sorted((r for r in map(tuple, frame(spark).collect()) if r[0] in rows), key=repr)
    assert M.mix(frame(spark)).count() == len(edge_rows())
    assert M.mix(frame(spark, [])).count() == M.keep_sampled(frame(spark, [])).count() == 0


def test_clashing_names(spark):
    odd = frame(spark).withColumns({"Cell_rate": F.lit(1), "cell": F.lit("x"), "topic": F.lit("t"), "rate": F.lit(9)})
    kept = M.keep_sampled(odd)
    assert kept.columns == odd.columns and kept.count() == M.keep_sampled(frame(spark)).count() == M.mix(odd).where("kept").count()
