import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, collected, crc, edge_rows, frame
from graphloom.llm import bpe, classifier, common, components, exact, quality_rules, queries, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sample(spark, sf_dir, n=None):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:n]


def pairs():
    return [(r[0], r[1] or "") for r in edge_rows()]


# --- 1: BPE


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)

    def expected(i, text):
        ids = library.encode(text, add_special_tokens=False).ids
        raw, decoded = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode()
        return i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()

    assert collected(bpe.encode_documents(frame(spark), VOCABULARY)) == sorted((expected(*p) for p in pairs()), key=repr)
    assert collected(queries.op1_bpe_encoding(spark, sf_dir)) == sorted((expected(*p) for p in sample(spark, sf_dir)), key=repr)


@pytest.mark.parametrize(
    "text",
    ["", "<|endoftext|>x<|startoftext|><|endoftext|", "ΑΣ ΣΑΣ İstanbul Ǳ", "it's IT'S don'T 'sx", "日本語 한국어 ½² ⅷ 😀", "a" * 3000, "\x1c!\x1d\x85 x", "é Å"],
)
def test_bpe_odd_texts(text):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), bpe.tokenizer_for(open(VOCABULARY, "rb").read())
    ids = library.encode(text, add_special_tokens=False).ids
    encoded = own.encode(text)
    assert list(struct.unpack(f"<{len(encoded) // 4}I", encoded)) == ids
    assert own.decode(encoded).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_every_token_is_its_own_encoding():
    encoder = bpe.tokenizer_for(open(VOCABULARY, "rb").read()).encoder
    for text, n in encoder.by_text.items():
        if ord(text[-1]) >= 256 and all(ord(c) < 256 for c in text[:-1]):
            assert encoder.encode(text[:-1].encode("latin-1") + bytes([ord(text[-1]) - 256])) == [n]


def test_bpe_returns_ids_and_text(spark):
    row = bpe.encode_documents(frame(spark).where("doc_id = 1"), VOCABULARY, with_ids=True, with_text=True).first()
    assert len(row.token_ids) == row.n_tokens and row.decoded


# --- 2: exact duplicates


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark, sf_dir):
    assert collected(exact.exact_duplicates(frame(spark))) == exact_expected(pairs())
    assert collected(exact.op2_exact_dedup(spark, sf_dir)) == exact_expected(sample(spark, sf_dir))
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_survives_colliding_hashes(spark):
    weak = exact.exact_duplicates(frame(spark), hash_of=lambda t: F.length(t) % 3)
    assert collected(weak) == exact_expected(pairs())


def test_exact_keeps_one(spark):
    kept = exact.keep_one(frame(spark))
    texts = [r.text or "" for r in kept.collect()]
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert len(texts) == len(set(texts)) and set(texts) == {t for i, t in pairs() if i is not None}


# --- 3, 9: learned scores


@pytest.mark.parametrize("column, modulus, held, limit", [("toxic", 3, 1, 0.7), ("quality", 5, 0, 0.3)])
def test_learned_scores(spark, column, modulus, held, limit):
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        marker = {"toxic": "moron", "quality": "buy!!"}[column]
        words = [f"w{(i * 7 + k * k) % 50}" for k in range(30)]
        rows.append((i, " ".join(words[:10] + [marker] * (6 if column == "quality" else 1) * bad + words[10:]), int(bad) if column == "toxic" else int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    score = toxicity.toxicity_scores if column == "toxic" else classifier.quality_scores
    kind = toxicity.Params(l1=1.0) if column == "toxic" else classifier.Params(epochs=6)
    found = {r.doc_id: r for r in score(docs, labels, p=kind).collect()}
    wanted = {i: y for i, _, y in rows}
    assert all(r.held_out == (crc(i, modulus) == held) and r.predicted == int(r.score >= limit) for i, r in found.items())
    assert sum(found[i].predicted == wanted[i] for i in found if found[i].held_out) >= 0.95 * sum(r.held_out for r in found.values())
    # labels of held-out rows are not read
    flipped = labels.withColumn(column, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, 1 - F.col(column)).otherwise(F.col(column)))
    assert {r.doc_id: r.score for r in score(docs, flipped, p=kind).collect()} == {i: r.score for i, r in found.items()}
    odd = score(frame(spark), labels, docs, kind).collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r.score <= 1 for r in odd)
    nothing = score(docs, labels.limit(0), p=kind).collect()
    assert len({r.score for r in nothing}) == 1


# --- 5: quality rules


def rules_expected(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(lines.values()) - len(lines), len(repeated), failed


def test_rules(spark, sf_dir):
    for df, rows in ((quality_rules.quality_rules(frame(spark)), pairs()), (quality_rules.op5_quality_rules(spark, sf_dir), sample(spark, sf_dir))):
        shown = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert collected(shown) == sorted((rules_expected(*r) for r in rows), key=repr)
        assert df.where("base_failed AND kept").count() == 0


def test_rule_ablations(spark):
    rows = quality_rules.ledger(frame(spark)).cache()
    mask = quality_rules.mask_of(quality_rules.POLICIES["strict-2"])
    failed = [r.failed & mask for r in rows.collect()]
    for r in quality_rules.ablations(rows, "strict-2").collect():
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_removed_without) == (sum(bool(f & bit) for f in failed), failed.count(bit), sum(bool(f & ~bit) for f in failed))


# --- 10: SimHash


def simhash_expected(rows, radius=3):
    import xxhash

    def print_of(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        if not words:
            return 0
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    near = [[m for m in range(len(rows)) if (prints[n] ^ prints[m]).bit_count() <= radius] for n in range(len(rows))]
    while changed:
        changed = False
        for n in range(len(rows)):
            if (least := min(label[m] for m in near[n])) < label[n]:
                label[n], changed = least, True
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[label[n]].append(i)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((i, f"{prints[n]:016x}", name[label[n]]) for n, (i, _) in enumerate(rows)), key=repr)


def test_simhash(spark, sf_dir):
    assert collected(simhash.near_duplicates(frame(spark))) == simhash_expected(pairs())
    assert collected(simhash.near_duplicates(frame(spark), most=3)) == simhash_expected(pairs())
    for radius in (0, 1, 6):
        assert collected(simhash.near_duplicates(frame(spark), radius=radius)) == simhash_expected(pairs(), radius)
    assert collected(simhash.op10_simhash_near_dedup(spark, sf_dir)) == simhash_expected(sample(spark, sf_dir))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    import random

    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:80]:
        assert sorted(tree.values[n] for n in tree.search(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_close_fingerprints_share_a_shard(spark, radius):
    import random

    rng = random.Random(radius)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), radius))
        pairs.append(tuple(x - (x >> 63 << 64) for x in (a, b)))
    rows = spark.createDataFrame(pairs, "a long, b long").select(*(simhash.shards_of(F.col(c), radius).alias(c) for c in "ab")).collect()
    assert all(set(r.a) & set(r.b) for r in rows) and all(len(set(r.a)) == len(r.a) for r in rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200), (300, 301), (301, 300)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.encode_documents(none, VOCABULARY).count() == quality_rules.quality_rules(none).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == classifier.quality_scores(none, labels).count() == 0
    assert {(r.n_failed, r.n_only, r.n_removed_without) for r in quality_rules.ablations(quality_rules.ledger(none)).collect()} <= {(0, 0, 0)}


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"t{k}") for k in range(50)] + [(2, "u"), (3, None), (4, "v")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 9 + [(2, 0, 1), (3, 1, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert common.labelled_sample(docs, labels, "quality", F.lit(True), 10) == ([b"t0", b"u"], [1, 0])
    assert len(common.labelled_sample(docs, labels, "quality", F.lit(True), 1)[0]) <= 1
