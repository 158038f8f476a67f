"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, t string, fp long, kept string, h_ int"


def edge_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta,", "gamma", "delta.", "été", "idiot", "!!", "the", "of", "and", "ñu", "$$$", "x|y"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        text = " ".join(words)
        if i % 7 == 0:
            text += "\n" + text[:40] + "\n" + text[:40]
        rows.append((i, text))
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(110, rows[3][1]), (110, rows[3][1])]  # a repeated row
    rows += [(120, None), (121, ""), (122, " \t\n "), (None, "some text of a null id"), (None, rows[4][1]), (None, None)]
    rows += [(130, " ".join(rng.choice(vocabulary) for _ in range(30_000))), (131, "a" * 50_000)]
    return [(i, t, None if i and i % 3 else "en", None, -1, 7, "x", 9, "no", 1) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)


def crc(i, modulus):
    return 0 if i is None else zlib.crc32(str(i).encode()) % modulus


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
