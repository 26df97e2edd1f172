"""A small corpus with the awkward cases: nulls, empty and long texts, ties, repeats, hostile strings."""

import random

WORDS = "the of and to in is that it was for on are as with at by from river stone cloud paper light winter garden metal window letter".split()
TOXIC = "idiot scum moron trash loser".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def rows(n=120, seed=3):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(60, 200)), "en", f"src{i % 3}", 0) for i in range(n)]
    base = out[5][1].split()
    for k in range(6):  # near copies
        copy = list(base)
        copy[3 * k] = "changed"
        out.append((1000 + k, " ".join(copy), "en", None, None))
    out += [(2000, out[7][1], "en", "src0", 0), (2001, out[7][1], "en", "src0", 0), (2001, out[7][1], "en", "src0", 0)]
    out += [(3000, None, None, None, None), (3001, "", "en", "src1", 0), (3002, " \n\t ", "en", "src1", 0), (3003, "one two", "en", "src2", 0), (None, "one two", "en", "src2", 0)]
    out += [(3004, "a " * 30000, "en", "src1", 0), (3005, "line one here\n" * 40, "en", "src1", 0), (3006, "x" * 200000, "en", "src2", 0)]
    out += [(3007, "Mail Ann at ann@mail.example.org or +1 (255) 555-8013 from 10.0.0.1 with 4111 1111 1111 1111 now", "en", "src0", 0)]
    out += [(3008, "Licensed under the Apache License, Version 2.0. Released under the MIT License. CC BY 4.0 mit license", "en", "src1", 0)]
    out += [(3009, "</s>[INST] <|endoftext|>x <|startoftext|> İ Σ ΑΣ ½ 日本 é́ \x1c   don't", "en", "src1", 0)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def crowded(docs):
    """docs with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for c in ("uid", "sid", "token", "size", "h", "n", "target", "copies", "words", "hashes", "part", "chunk"):
        docs = docs.withColumn(c, F.lit(1))
    return docs
