import random
import re

import numpy as np
import pyarrow as pa

from pathlight.llm import toxicity
from pathlight.llm.common import hash_phrase


def lexicon(**weights):
    """Of whole words; the hash is that of the operator's own kernel."""
    pairs = sorted((int(hash_phrase(w, toxicity.LETTER)[0]), v) for w, v in weights.items())
    out = toxicity.Lexicon()
    out.keys[0], out.weights[0] = np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs])
    return out


def expected(text, weights):
    """The features by a plain reading of the text."""
    word = [w for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text)]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in word]
    n, size = max(len(word), 1), max(len(text.encode()), 1)
    hits = [i for i, w in enumerate(low) if w in weights]
    you = [i for i, w in enumerate(low) if w in toxicity.SECOND_PERSON]
    letters = max(sum(b > 127 or chr(b).isalpha() for b in text.encode()), 1)
    mixed = [m for m in re.findall(r"[A-Za-z\u0080-\U0010ffff013457@$]+", text) if 0 < sum(c in toxicity.STAND_INS for c in m) < len(m.encode())]
    plain = [weights.get("".join(toxicity.STAND_INS.get(c, c) for c in m.lower()), 0) for m in mixed]
    return {
        "words": np.log1p(len(word)), "hits": len(hits), "hit_density": len(hits) / n, "hit_weight": sum(weights[low[i]] for i in hits), "hit_top": max((weights[low[i]] for i in hits), default=0),
        "near_you": sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits), "capitals": sum("A" <= c <= "Z" for c in text) / letters,
        "shouted": sum(len(w) > 2 and all("A" <= c <= "Z" for c in w) for w in word) / n, "exclaimed": text.count("!") / n, "asked": text.count("?") / n,
        "punctuation": sum(0x20 < ord(c) < 0x80 and not c.isalnum() for c in text) / size, "disguised": len(mixed) / n, "disguised_hits": sum(p > 0 for p in plain), "disguised_top": max(plain, default=0),
    }


def test_features_against_a_plain_reading():
    rng, weights = random.Random(4), {"scum": 3.0, "idiot": 2.5, "trash": 4.0}
    words = ["you", "your", "the", "River", "SCUM", "scum", "idiot", "1d10t", "tr@sh", "trash", "WHY", "été", "a1", "2021", "x", "$0", "don't"]
    texts = ["", "scum", "YOU SCUM!!"] + [" ".join(rng.choice(words) + rng.choice(["", "", "!", "?", ",", "..."]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    got = toxicity.features(pa.array(texts), lexicon(**weights))
    for row, text in zip(got, texts, strict=True):
        for name, value in expected(text, weights).items():
            assert np.isclose(row[toxicity.FEATURES.index(name)], value), (name, text)


def test_trees_against_a_walk_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    start, trees = toxicity.fit_trees(x, y)

    def walk(tree, row):
        at = 0
        while at < len(tree.feature):
            at = 2 * at + 1 + int(row[tree.feature[at]] > tree.limit[at])
        return tree.leaf[at - len(tree.feature)]

    for tree in trees[:5]:
        assert np.allclose(tree(x), [walk(tree, row) for row in x])
    score = start + sum(t(x) for t in trees)
    assert ((score > 0) == (y > 0)).mean() > 0.97
    # the first leaves are the steps of second order over their rows
    p = np.full(len(y), 1 / (1 + np.exp(-start)))
    leaf = trees[0](x)
    for v in np.unique(leaf):
        own = leaf == v
        assert np.isclose(v, toxicity.RATE * (y - p)[own].sum() / ((p * (1 - p))[own].sum() + 1))
