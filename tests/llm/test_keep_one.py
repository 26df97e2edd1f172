from collections import Counter

from pathlight.llm import ngram_join
from tests.llm import corpus


def test_null_and_repeated_ids_lose_no_text(spark):
    t = [r[1] for r in corpus.rows(12)[:12]]
    near = " ".join(["changed", *t[3].split()[1:]])
    data = [(None, t[0]), (None, t[1]), (None, t[1]), (10, t[2]), (10, t[3]), (5, near), (11, t[4]), (11, t[5]), (None, t[4]), (12, t[6]), (12, t[6]), (None, ""), (None, None), (13, " "), (13, "")]
    docs = corpus.frame(spark, [(i, x, "en", "s", 0) for i, x in data]).repartition(4)
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect())
    want = Counter([(None, t[0]), (None, t[1]), (10, t[2]), (5, near), (11, t[4]), (11, t[5]), (12, t[6]), (None, ""), (None, None), (13, " "), (13, "")])
    assert got == want
