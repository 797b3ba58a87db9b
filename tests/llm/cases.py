"""Rows that operators must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for results or inside
    *[T.StructField(n, T.StringType()) for n in ("score", "kept", "copy", "keep_id", "row", "n", "digest", "_text", "id")],
])


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = ["the", "of", "Über", "straße", "don't", "x%y", "niño", "été", "||", "alpha", "beta", "gamma", "delta"] + [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = line(60), [line(80) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "a  b\tc\nd"), (7, "ab cd"), (8, "!?"), (9, "  ab  cd ")]
    rows += [(10 + i, b) for i, b in enumerate(base)]
    rows += [(20 + i, b) for i, b in enumerate(base[:3])]  # exact copies
    rows += [(30 + i, b.replace(" ", "  ", 3).upper()) for i, b in enumerate(base[:2])]
    for i in range(8):  # near copies, and texts with a common passage
        w = base[3].split()
        w[r.randrange(80)] = f"new{i}"
        rows += [(40 + i, " ".join(w)), (60 + i, line(30) + " " + passage + " " + line(30))]
    rows += [(80, "\n".join([line(12)] * 4 + [line(9)])), (81, "same same same " * 30), (82, line(6000)), (83, "a" * 3000), (84, "é \U0001F600 あい \x1c\x85 z")]
    rows += [(10, base[0]), (10, base[0]), (90, base[1]), (90, line(50)), (None, base[2]), (None, line(40)), (None, None), (-5, base[0] + " end")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    full = [(i, t, "en", f"src{(i or 0) % 3}" if i is None or i % 7 else None, len(t or ""), *["x"] * (len(SCHEMA) - 5)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
