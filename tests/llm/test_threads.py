import random
import re
from collections import defaultdict

import pytest

from cases import collected
from graphloom.llm import threads

SCHEMA = "conv_id long, turn long, role string, text string, hash string, place int, level string"


def normal(text):
    return re.sub(r"\s+", " ", text).lower().strip(" ")


def parsed(text):
    if not re.search(r"(?m)^[ \t]*>", text):
        return text, []
    lines = []
    for line in re.split("\r?\n", text):
        marks = re.match(r"(?:[ \t]*>)+", line)
        lines.append((marks[0].count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)) if marks else (0, line))
    for i, (level, body) in enumerate(lines[:-1]):
        if level == 0 and lines[i + 1][0] > 0 and re.match(threads.ATTRIBUTION, body):
            lines[i] = (-1, body)
    own = re.sub(r"^\s+|\s+$", "", "\n".join(b for level, b in lines if level == 0))
    runs = []
    for level, body in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    passages = [(level, k, normal(" ".join(bodies)), "\n".join(bodies)) for k, (level, bodies) in enumerate(runs)]
    return own, [p for p in passages if p[0] > 0 and p[2]]


def original_of(passage, raw, units, turn):
    """The turn that a passage is from: as a whole, by all its paragraphs, or by all its lines."""
    if units.get(passage, turn) < turn:
        return units[passage]
    if "\n" in raw:
        for pieces in (re.split(r"\n[ \t\r]*\n", raw), raw.split("\n")):
            at = [units.get(normal(p), turn) for p in pieces if normal(p)]
            if at and max(at) < turn:
                return max(at)
    return None


def expected(rows):
    out, convs = [], defaultdict(lambda: defaultdict(list))
    for c, t, role, text in rows:
        own, quoted = parsed(text or "")
        out.append((c, t, role, own, quoted))
        if c is not None and t is not None:
            convs[c][t].append((own, quoted))
    place = {}
    for c, turns in convs.items():
        units = {}
        for t in sorted(turns):
            for own, _ in turns[t]:
                for u in [own, *re.split(r"\n[ \t\r]*\n", own), *own.split("\n")]:
                    units.setdefault(normal(u), t)
        parents, linked = {}, {}
        before = None
        for t in sorted(turns):
            found = {(level, k, p): original for _, quoted in turns[t] for level, k, p, raw in quoted if (original := original_of(p, raw, units, t)) is not None}
            links = {(level, k, original) for (level, k, _), original in found.items()}
            linked[t] = len(found)
            parents[t] = min(links)[2] if links else before
            before = t
        children = defaultdict(list)
        for t in sorted(parents):
            children[parents[t]].append(t)
        todo, order = list(reversed(children[None])), 0
        while todo:
            t = todo.pop()
            order += 1
            place[c, t] = (parents[t], order, linked[t])
            todo += reversed(children[t])
    return sorted(((c, t, role, own, *place.get((c, t), (None, None, 0))[:2], len(q), place.get((c, t), (0, 0, 0))[2]) for c, t, role, own, q in out), key=repr)


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(8):
        said = []
        for t in range(0, rng.randrange(1, 25) * 2, rng.choice([1, 2])):
            own = "\n".join(" ".join(rng.choice("Ja no  maybe of The sure été".split(" ")) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4)))
            text = own
            if said and rng.random() < 0.6:
                source = rng.choice(said)
                part = rng.choice([source, source.split("\n")[0], "\n".join(source.split("\n")[1:]), "\n".join(source.split("\n")[:2]), "never said by anyone", ""])
                text = "On Monday, X wrote:\n" * rng.randrange(2) + "\n".join(rng.choice(["> ", ">", " > "]) + x.upper() for x in part.split("\n")) + "\n" + own
            if said and rng.random() < 0.3:
                text += "\r\n>> " + rng.choice(said).replace("\n", "\n>  > ") + "\n> " + rng.choice(said).replace("\n", "\n>")
            said.append(text)
            rows.append((c, t, rng.choice(["user", "assistant", None]), text))
    rows += [rows[3], rows[3], (0, 2, "other", "same turn"), (50, 0, "user", None), (50, 1, "user", ""), (51, 5, None, "> x"), (52, -3, "a", "hm"), (52, 9000, "b", "> hm\nyes"), (52, 20_000, "b", "no")]
    rows += [(None, 1, "user", "> a\nb"), (1, None, "user", "x"), (None, None, None, None)]
    rows += [(53, 0, "user", "word\n" * 3000), (53, 1, "user", "> word\n" * 3000 + "ok"), (53, 2, "user", ">" * 500 + " word")]
    return rows


@pytest.mark.parametrize("block", [threads.BLOCK, 3])
def test_links_and_order(spark, block):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert collected(threads.link_quotations(frame, block)) == expected(rows)


def test_trimmed_quotations_find_their_original(spark):
    said = "first of all\nit is late\n\nsecond, we\nare tired\n\nthird"
    replies = ["> it is late\n> second, we\nwhy?", "> first of all\n> it is late\n>\n> third\nyes", ">> second, we are tired\n>>\n>> third\nno", "> it is late\n> says who\nhm"]
    rows = [(1, 0, "a", said), (1, 1, "b", "third"), (1, 2, "b", "well"), *((1, 3 + k, "c", r) for k, r in enumerate(replies))]
    found = {r.turn: (r.parent_turn, r.n_linked) for r in threads.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[3 + k] for k in range(4)] == [(0, 1), (0, 1), (0, 1), (5, 0)]
    assert collected(threads.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == expected(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_sql_on_made_conversations(spark, seed):
    """The supplied table holds no quotations, so the SQL is compared on these."""
    import duckdb
    import pandas as pd

    made = [r for r in conversations(seed) if r[0] not in (53,)]
    con = duckdb.connect()
    con.register("made", pd.DataFrame(made, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM made")
    frame = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    assert collected(threads.link_quotations(frame)) == sorted(map(tuple, con.sql(threads.ORACLE).fetchall()), key=repr)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(threads.op4_quotation_linking(spark, sf_dir)) == expected(rows)
    assert threads.link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0
