"""Small corpora with everything that can go wrong, and plain restatements."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("chunk", "shard", "answer", "node", "token", "label", "size", "words", "stats", "keep_0", "carry_0")],
])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    """(doc_id, text[, lang, source]) rows as documents with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), *["x"] * 11) for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed=0, n=60, vocabulary=60):
    """Random texts with copies, near copies, shared passages, odd white space, empty, null and very long ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "été", "ß", "x" * 40, "x" * 39 + "y", "語", "no!"]) if rng.random() < 0.1 else f"w{rng.randrange(vocabulary * 40)}"
    space = lambda: rng.choice([" ", "\n", "\t", "  ", " \r\n", "  "])
    make = lambda k: "".join(word() + space() for _ in range(k))
    passage, rows = make(30), []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1] or ""
        elif rows and kind < 0.4:
            parts = (rng.choice(rows)[1] or "a").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind < 0.5:
            text = make(rng.randrange(20)) + " " + passage + make(rng.randrange(20))
        else:
            text = make(rng.choice([0, 1, 3, 4, 5, 12, 13, 14, 60, 150]))
        rows.append((i * 3 % (n * 2 + 1), text))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, make(4000)), (1004, "one")]
