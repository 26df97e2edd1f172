"""Toxicity by gradient-boosted trees over dense features (operator 4).

Labelled rows whose crc32(doc_id as text) mod 3 is not 1 may be learnt from; a bounded
sample of them, SAMPLE_ROWS by hash, is. It is dealt in three by hash: the first part
gives the lexicon (words and word beginnings that toxic texts hold far more often), the
second fits the trees, the third the isotonic calibration. Features of a text are lexicon
densities, hits near second-person words, capitals, punctuation and obfuscation rates;
nothing but the text goes in.

Null and empty texts have all features 0 and score as such. Rows that repeat score alike,
an empty table gives an empty result, and without labels of both kinds every text scores
the base rate. Labels may be null (left out) or repeated (the highest counts).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.llm.common import _CODES, bytes_of, crc_mod, discard, documents, hash_phrase, materialize, slices, span_hashes, text_or_empty, trimmed, words

#: Labelled rows that are learnt from at most, and how ten parts of them are dealt.
SAMPLE_ROWS, DEAL = 16_000, (5, 3, 2)
#: Toxic texts that hold a lexicon entry at least, its log odds and its likelihood ratio at least. The bounded sample bounds the entries.
LEAST_TEXTS, LEAST_ODDS, LEAST_RATIO = 4, 2.0, 16.0
#: Bytes of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 3, 0.15, 32, 10
THRESHOLD = 0.7
NEAR = 3

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
#: Signs that stand for letters inside words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DISGUISED = LETTER.copy()
LEET = np.zeros(256, bool)
_PLAIN = _CODES.copy()
for _a, _b in STAND_INS.items():
    DISGUISED[ord(_a)] = LEET[ord(_a)] = True
    _PLAIN[ord(_a)] = _CODES[ord(_b)]
#: Words that address the reader.
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "ihr", "tu", "te", "toi", "vous", "votre", "ton", "tú", "ti", "usted", "ustedes", "su")
_YOU = np.unique(np.concatenate([hash_phrase(w, LETTER) for w in SECOND_PERSON]))
FEATURES = ("words", "hits", "hit_density", "hit_weight", "hit_top", "starts", "start_density", "start_weight", "start_top", "near_you", "capitals", "shouted", "exclaimed", "asked", "punctuation", "disguised", "disguised_hits", "disguised_top")


@dataclass
class Lexicon:
    """Sorted hashes and weights, of words at 0 and of word beginnings of n bytes at n."""

    keys: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def of(self, part: int, hashes: np.ndarray) -> np.ndarray:
        keys = self.keys.get(part)
        if keys is None or not len(keys) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, self.weights[part][at], 0.0)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Words of each row and, by part, (indices of words, hashes)."""
    first, hashes, starts, ends = words(data, offsets, LETTER)
    out = {0: (np.arange(len(hashes)), hashes)}
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n)
        out[n] = (long, span_hashes(data, starts[long], starts[long] + n))
    return first, out, starts, ends


def features(array: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, offsets = bytes_of(array)
    rows = len(array)
    out = np.zeros((rows, len(FEATURES)))
    first, parts, starts, ends = units(data, offsets)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    total = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1)

    def by_row(values: np.ndarray, of: np.ndarray = row) -> np.ndarray:
        return np.bincount(of, values, rows)

    def top(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        best = np.zeros(rows)
        np.maximum.at(best, of, values)
        return best

    weight = lexicon.of(0, parts[0][1])
    begun = np.zeros(len(weight))
    for p in BEGINNINGS:
        at, h = parts[p]
        begun[at] = np.maximum(begun[at], lexicon.of(p, h))
    hit, start = np.flatnonzero(weight > 0), np.flatnonzero(begun > 0)
    either = np.union1d(hit, start)
    you = np.flatnonzero(np.isin(parts[0][1], _YOU))
    near = np.zeros(len(either), bool)
    if len(you) and len(either):
        for side in (np.searchsorted(you, either) - 1, np.searchsorted(you, either)):
            at = you[np.clip(side, 0, len(you) - 1)]
            near |= (np.abs(at - either) <= NEAR) & (row[at] == row[either])
    byte = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    upper = (data >= 0x41) & (data <= 0x5A)
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (ups[ends] - ups[starts] == ends - starts) & (ends - starts > 2)
    _, _, s2, e2 = words(data, offsets, DISGUISED)
    leet = np.concatenate([[0], np.cumsum(LEET[data])])
    mixed = np.flatnonzero((leet[e2] > leet[s2]) & (leet[e2] - leet[s2] < e2 - s2))
    row2 = np.searchsorted(offsets, s2[mixed], "right") - 1
    plain = lexicon.of(0, span_hashes(data, s2[mixed], e2[mixed], _PLAIN))
    letters = np.maximum(byte(LETTER[data]), 1)
    punct = byte((data > 0x20) & (data < 0x80) & ~LETTER[data] & ~((data >= 0x30) & (data <= 0x39)))
    values = [
        np.log1p(n), by_row(np.ones(len(hit)), row[hit]), None, by_row(weight[hit], row[hit]), top(weight[hit], row[hit]),
        by_row(np.ones(len(start)), row[start]), None, by_row(begun[start], row[start]), top(begun[start], row[start]),
        by_row(near.astype(float), row[either]), byte(upper) / letters, by_row(shouted.astype(float)) / total, byte(data == 0x21) / total, byte(data == 0x3F) / total, punct / size,
        by_row(np.ones(len(mixed)), row2) / total, by_row((plain > 0).astype(float), row2), top(plain, row2),
    ]
    values[2], values[6] = values[1] / total, values[5] / total
    for k, v in enumerate(values):
        out[:, k] = v
    return out


@dataclass
class Tree:
    """A full tree of DEPTH levels in arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.limit[at])
        return self.leaf[at - (2**DEPTH - 1)]


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Second-order boosting of the logistic loss over binned features."""
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    start = float(np.log(rate / (1 - rate)))
    trees: list[Tree] = []
    if not len(y) or y.min() == y.max():
        return start, trees
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # the quantiles of a feature that is mostly 0 miss its few values: cut right above 0, and within what exceeds it
    cuts = [np.unique(np.concatenate([c, [0.0], np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) - 1e-9 if (v > 0).any() else []])) for c, v in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        inner = 2**DEPTH - 1
        tree = Tree(np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**DEPTH))
        at = np.zeros(len(y), int)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, None)
            if len(mine) >= 2 * LEAST_ROWS:
                gs, hs = g[mine], h[mine]
                whole = gs.sum() ** 2 / (hs.sum() + 1)
                for f, c in enumerate(cuts):
                    b = binned[mine, f]
                    gl, hl, nl = (np.bincount(b, w, len(c) + 1)[:-1].cumsum() for w in (gs, hs, np.ones(len(b))))
                    gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
                    gain[(nl < LEAST_ROWS) | (len(b) - nl < LEAST_ROWS)] = 0
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (gain[k], f, c[k], b > k)
            tree.feature[node], tree.limit[node] = best[1], best[2]
            at[mine] = 2 * node + 1 + (best[3] if best[3] is not None else 0)
        leaf = at - inner
        tree.leaf = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += tree.leaf[leaf]
        trees.append(tree)
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, means) to interpolate between, both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: Lexicon
    start: float
    trees: list[Tree]
    curve: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        plain = 1 / (1 + np.exp(-raw))
        if not len(self.curve[0]):
            return plain
        # a little of the uncalibrated score keeps the order within a calibrated step
        return np.clip(0.99 * np.interp(raw, *self.curve) + 0.01 * plain, 0, 1)


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and part of at most SAMPLE_ROWS labelled rows that may be learnt from."""
    may = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    may = may.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by = F.xxhash64(F.col("doc_id"), F.lit(7))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(sum(DEAL)))
    part = F.when(part < DEAL[0], 0).when(part < DEAL[0] + DEAL[1], 1).otherwise(2)
    return may.orderBy(by, "doc_id").limit(SAMPLE_ROWS).select("doc_id", "toxic", part.alias("part"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From text and toxic: counts of the texts of either kind that hold each unit, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = bytes_of(batch.column("text"))
                first, parts, _, _ = units(data, offsets)
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
                for p, (at, h) in parts.items():
                    order = np.lexsort((h, row[at]))
                    r, h = row[at][order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                    r, h = r[new], h[new]
                    keys, back, n = np.unique(h, return_inverse=True, return_counts=True)
                    bad = np.bincount(back, toxic[r] > 0, len(keys)).astype(np.int64)
                    # all go on, as a unit without a toxic text here may have one in another slice
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p), pa.int32()), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(n.astype(np.int64))], ["part", "key", "bad", "n"])

    texts = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = texts.get(True, 0), texts.get(False, 0)
    counts = rows.select("text", "toxic").mapInArrow(count, "part int, key bigint, bad bigint, n bigint").groupBy("part", "key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
    rate = bad / max(bad + good, 1)
    if not 0 < rate < 1:
        return Lexicon()
    term = lambda x, share: F.when(x > 0, x * F.log(x / F.col("n") / share)).otherwise(0.0)
    ratio = 2 * (term(F.col("bad"), rate) + term(F.col("n") - F.col("bad"), 1 - rate))
    kept = counts.filter(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).collect()
    out = Lexicon()
    for p in (0, *BEGINNINGS):
        mine = sorted((np.int64(r["key"]).view(np.uint64), r["odds"]) for r in kept if r["part"] == p)
        out.keys[p] = np.array([k for k, _ in mine], np.uint64)
        out.weights[p] = np.array([w for _, w in mine], float)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample = materialize(learnable(labels))
    # SAMPLE_ROWS bounds what is broadcast
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic", "part")
    rows = materialize(rows)
    lexicon = learn_lexicon(rows.filter("part = 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = features(batch.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["part", "toxic", "x"])

    got = rows.filter("part > 0").mapInArrow(run, "part int, toxic int, x array<double>").orderBy("part", "toxic", "x").collect()
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    y, part = np.array([float(r["toxic"] > 0) for r in got]), np.array([r["part"] for r in got])
    discard(sample, rows)
    start, trees = fit_trees(x[part == 1], y[part == 1])
    model = Model(lexicon, start, trees, (np.empty(0), np.empty(0)))
    held = part == 2
    if trees and held.any():
        model.curve = isotonic(model.raw(x[held]), y[held])
    return model


SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                s = model.score(features(batch.column("text"), model.lexicon))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(trimmed(run), SCORES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
