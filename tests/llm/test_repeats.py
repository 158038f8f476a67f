import hashlib
import random

import pytest

from cases import collected, edge_rows, frame
from graphloom.llm import repeats


def expected(rows, size=repeats.THRESHOLD):
    """All windows of all texts, in order, in a set."""
    texts = {(repeats._LAST if i is None else i, repeats._tie(t.encode()), t.encode(), i) for i, t in rows}
    seen, found = set(), {}
    for _, _, x, i in sorted(texts, key=lambda r: r[:2]):
        gone, done = bytearray(len(x)), 0
        for k in range(len(x) - size + 1):
            window = x[k : k + size]
            if window in seen:
                start = max(k, done)
                gone[start : k + size] = b"\1" * (k + size - start)
                done = k + size
            seen.add(window)
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        found[i, x] = (i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((found[i, t.encode()] for i, t in rows), key=repr)


@pytest.mark.parametrize("sparse, piece", [(repeats.SPARSE, repeats.PIECE), (1, 3), (10**6, 2), (2, 10**6)])
def test_edge_rows(spark, sparse, piece):
    """Also where anchors are split, by the tasks that read or by those that sort."""
    pairs = [(r[0], r[1] or "") for r in edge_rows()]
    assert collected(repeats.remove_repeats(frame(spark), sparse=sparse, piece=piece)) == expected(pairs)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(repeats.op6_suffix_dedup(spark, sf_dir)) == expected(rows)


def test_kept_bytes_and_empty_table(spark):
    row = repeats.remove_repeats(frame(spark).where("doc_id = 131"), with_text=True).first()
    assert row.kept_bytes == b"a" and row.n_removed == 49_999 and row.n_spans == 1
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_anchors_cover_each_window_once(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"x" * 500 + rng.randbytes(500)
    whole = repeats.anchors(text)
    position, _, first, last = whole
    assert first[0] == 0 and last[-1] == len(text) - repeats.THRESHOLD and (first[1:] == last[:-1] + 1).all()
    assert (first <= position).all() and (position + repeats.GRAM <= last + repeats.THRESHOLD).all()
    monkeypatch.setattr(repeats, "_PIECE", 700)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(text)))


def test_bytes_decide_where_grams_collide():
    """Contexts that share a number of their anchor, but not its bytes."""
    one, two = bytes(range(32)) * 4, bytes(range(100, 132)) * 4
    rows = repeats._Rows()
    repeats._sort([(7, 1, 40, 10, one), (7, 2, 40, 10, two), (7, 3, 40, 10, one[:-1] + b"!"), (7, 4, 41, 11, b"x" + one)], rows, split=False)
    # the third has all but the last window of the first, the fourth has all of its windows
    assert [tuple(int(c[k]) for c in p[2:]) for p in rows.parts for k in range(len(p[0]))] == [(3, 30, -127), (4, 31, -128)]
