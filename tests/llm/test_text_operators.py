import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathlight.llm import bpe, chat, common, licenses, mixing, ngram_join, pii, quality, toxicity
from tests.llm import corpus

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_kernel():
    import pyarrow as pa

    texts = ["a B  c\td", "", "ÀB a", "x" * (3 * common.BLOCK) + " y", "a b"]
    data, offsets = common.bytes_of(pa.array(texts))
    first, hashes, _, _ = common.words(data, offsets)
    words = [w for t in texts for w in low(t).encode().split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(by.values())) == len(by)
    begin, r = common.rolling(first, hashes, 2)
    assert np.diff(begin).tolist() == [3, 0, 1, 1, 1] and r[0] == r[-1]


def test_licenses(spark):
    docs = corpus.crowded(corpus.frame(spark))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    want = Counter()
    for i, text, *_ in corpus.rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        places = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        want[i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert got == want
    assert licenses.scan(corpus.empty(spark)).count() == 0


def test_long_license_with_an_insertion(spark):
    text = "before it " + licenses.LIBRARY["bsd"].replace("source and", "source or also") + " after"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.labels == "bsd" and r.base_labels == "" and r.score > 0.9 and r.spans[0].start <= 3


def test_license_after_a_repeated_stretch(spark):
    words = licenses.word_list(licenses.LIBRARY["bsd"])
    text = " ".join([*(["filler", *words[10:16]] * 40), *words, "end"])
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.labels == "bsd" and r.score > 0.9 and any(s.end - s.start <= 3 * len(words) and s.end >= 280 for s in r.spans)


def test_windows_over_a_merged_span_against_brute_force():
    import random

    rng = random.Random(2)
    template = [f"t{k}" for k in range(12)]
    for _ in range(200):
        have = [rng.choice(template + ["x"] * 20) for _ in range(60)]
        at = rng.randint(0, 48)
        have[at : at + 12] = template
        found = licenses.matched(template, have, rng.randint(0, at), 60)
        assert max((s for *_, s in found), default=0) == 1.0 and all(a < b for a, b, _ in found)
        assert any(a <= at and at + 12 <= b for a, b, s in found if s == 1.0)


def components(data):
    sets = []
    for _, text, *_ in data:
        w = low(text).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(data)))
    find = lambda v: v if root[v] == v else find(root[v])
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, d in enumerate(data):
        if d[0] is not None:
            least[find(k)].append(d[0])
    return Counter((d[0], len(sets[k]), min(least[find(k)], default=None) if sets[k] else d[0]) for k, d in enumerate(data))


@pytest.mark.parametrize("few", [64, 2])
def test_ngram_join(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "IN_BLOCK", 3)
    data = corpus.rows()
    got = Counter(tuple(r) for r in ngram_join.join_components(corpus.crowded(corpus.frame(spark, data))).collect())
    assert got == components(data)


def test_ngram_join_of_chains(spark):
    base = [f"w{k}" for k in range(60)]
    data = []
    for k in range(40):  # each link holds, distant ones don't
        data.append((k, " ".join(base[k : k + 30])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.join_components(docs).collect())
    assert got == components(data) and len({r[2] for r in got}) == 1


def test_ngram_join_keeps_one(spark):
    assert ngram_join.join_components(corpus.empty(spark)).count() == 0
    kept = ngram_join.keep_one(corpus.crowded(corpus.frame(spark)))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids and 5 in ids and not {2000, 2001, 1000, 1005} & set(ids) and {3000, 3001, 3002} <= set(ids)
    assert kept.columns == corpus.crowded(corpus.frame(spark)).columns


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    got = Counter(tuple(r) for r in bpe.encode_digests(corpus.crowded(corpus.frame(spark)), bpe.vocabulary_path()).collect())
    want, sha = Counter(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text, *_ in corpus.rows():
        e = lib.encode(text or "", add_special_tokens=False)
        want[i, len(e.ids), sha(" ".join(map(str, e.ids))), sha(lib.decode(e.ids, skip_special_tokens=False))] += 1
    assert got == want
    ids = bpe.encode_ids(corpus.frame(spark).filter("doc_id = 3009"), bpe.vocabulary_path()).collect()[0].ids
    assert 49407 in ids and bpe.encode_digests(corpus.empty(spark), bpe.vocabulary_path()).count() == 0


def test_personal_data(spark):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("a01234567890.@+- ()\né%") for _ in range(150)) for _ in range(1500)] + [r[1] or "" for r in corpus.rows() if len(r[1] or "") < 10000]
    for t in texts:
        want = sorted(((k, *m.span()) for k, p in rules.items() for m in re.finditer(p, t) if ok[k](m.group())), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert pii.base_spans(t) == want
    rows = {r.doc_id: r for r in pii.report(corpus.crowded(corpus.frame(spark))).collect()}
    assert (rows[3007].n_email, rows[3007].n_ip, rows[3007].n_card, rows[3007].n_phone) == (1, 1, 1, 1)
    assert rows[3000].spans == "" and rows[3].spans == "" and pii.report(corpus.empty(spark)).count() == 0


def test_crf_learns_its_table_and_adds_what_patterns_miss():
    crf = pii.train()
    for tokens, labels in pii._read_training():
        assert pii.viterbi([crf.scores(tokens)], crf.move)[0].tolist() == labels
    found = lambda t: pii.all_spans([t], crf)[0][1]
    assert found("call (415) 555-2671 now") == [("phone", 5, 19)]
    assert found("card 4111.1111.1111.1111 ok") == [("card", 5, 24)]
    for clean in ("in 2021 there were 14 of them, 3.5 each", "see 12/05/2020 at 10:30, pages 10-12", "10 20 30 40 50 60 70 80"):
        assert found(clean) == []


def test_redaction_keeps_rows(spark):
    docs = corpus.crowded(corpus.frame(spark))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "[EMAIL]" in got[3007].text and "ann@" not in got[3007].text and got[3007].n_chars == len(got[3007].text)
    assert got[3000].text is None and got[3].text == corpus.rows()[3][1]


def test_toxicity(spark):
    import random

    rng = random.Random(5)
    data = [(i, " ".join(rng.choices(corpus.WORDS, k=40) + (rng.choices(corpus.TOXIC, k=3) if i % 4 == 0 else [])), "en", "s", 0) for i in range(900)]
    docs = corpus.frame(spark, [*data, (5000, None, None, None, None), (5001, "", None, None, None)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.learn(corpus.crowded(docs), labels)).collect()
    assert len(rows) == 902 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 5000]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) > 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    flat = toxicity.score(docs, toxicity.learn(docs, labels.filter("toxic = 0")))
    assert flat.select("score").distinct().count() == 1 and toxicity.score(corpus.empty(spark), toxicity.learn(docs, labels.limit(0))).count() == 0


def test_isotonic_is_monotone():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 2, 5]), np.array([0.0, 0, 1, 0, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def repeats(w):
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)})


def test_quality(spark):
    got = Counter(tuple(r)[:7] for r in quality.measured(corpus.crowded(corpus.frame(spark))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, text, *_ in corpus.rows():
        w = SPACED.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
        r = repeats(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, len(w) < 50 or 100 * r > 50 * len(w)] += 1
    assert got == want


def test_quality_order_does_not_change_the_verdict(spark):
    docs = corpus.crowded(corpus.frame(spark))
    text = common.text_or_empty()

    def verdict(rules):
        return quality.let(quality.words(text), lambda w: quality.rejected_by(list(rules), quality.measures(text, w)).isNull())

    kept = {order: sorted(str(r[0]) for r in docs.filter(verdict(rules)).select("doc_id").collect()) for order, rules in (("forth", quality.RULES), ("back", quality.RULES[::-1]))}
    assert {r.name for r in quality.ordered(docs)} == {r.name for r in quality.RULES} and quality.sample_of(docs, "text").count() == docs.count()
    assert kept["forth"] == kept["back"] == sorted(str(r.doc_id) for r in quality.keep_good(docs).collect())
    assert {"1", "2"} <= set(kept["forth"]) and not {"3000", "3004", "3005"} & set(kept["forth"])
    assert quality.measured(corpus.empty(spark)).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_start|>", "ends with <", "a\\\\b <|x|>", "[\\\\INST]"]
    rows = [(i % 3, i, ["user", "assistant", "sys\ntem%0A", None][i % 4], t) for i, t in enumerate(texts * 3)] + [(9, None, "assistant", "x"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")]
    turns = chat.canonical_turns(corpus.crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    for c in (0, 1, 2, 9):
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in mine]
        assert list(back[c].learnt) == [x for _, r, x in mine if r == "assistant"]
        assert all(chat.OPEN not in back[c].formatted[s.start : s.end] for s in back[c].mask)
    assert chat.digests(turns.limit(0)).count() == 0


def test_chat_layouts(spark):
    lines = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"instruction": "q", "output": "a"}', '{"prompt": "q", "completion": "a"}', '{"question": "q", "answer": "a", "conv_id": "7"}', '{"messages": []}', '{"what": 1}', "broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = Counter((r.turn, r.role, r.text) for r in chat.json_turns(df).collect())
    assert got == Counter({(0, "user", "q"): 5, (1, "assistant", "a"): 5}) and chat.unmapped(df).count() == 2
    table = spark.createDataFrame([("q", "i", "a")], "instruction string, input string, output string")
    assert [r.text for r in chat.canonical_turns(table).orderBy("turn").collect()] == ["q\n\ni", "a"]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_chat_arrays_of_uneven_elements(spark):
    lines = ['{"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"content": "r", "role": "assistant", "x": 1}]}', '{"conversations": [], "conv_id": "8"}', '{"messages": [{"content": "lone"}, {"role": "user"}]}', '{"messages": null}', '{"messages": [1, "x"]}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = Counter((r.turn, r.role, r.text) for r in chat.json_turns(df).collect())
    assert got == Counter({(0, "system", ""): 1, (1, "user", "q"): 1, (2, "assistant", "r"): 1, (0, "", "lone"): 1, (1, "user", ""): 1})
    assert sorted(r.value for r in chat.unmapped(df).collect()) == sorted(lines[3:])


def test_mixing(spark):
    data = [(i, "w " * (1 + i % 9), "en", f"s{min(i % 7, 4)}", 0) for i in range(600)] + [(700, None, None, None, None), (701, "a b c", None, None, None), (1, "w w", "en", "s1", 0)]
    docs = corpus.frame(spark, data)
    plan = mixing.thresholds(mixing.sized_rows(docs)).collect()
    total = sum(r.source_size for r in plan)
    assert math.isclose(sum(r.target for r in plan), total) and all(r.target <= 3 * r.source_size + 1e-9 for r in plan)
    ranked = sorted(plan, key=lambda r: (r.source is None, r.source or ""))
    free = [r.target / (k % 3 + 1) for k, r in enumerate(ranked) if r.target < 3 * r.source_size]
    assert max(free) - min(free) < 1e-6
    out = mixing.mix(corpus.crowded(docs))
    assert out.columns == corpus.crowded(docs).columns
    size = lambda t: len(SPACED.findall(t or ""))
    taken = Counter()
    for r in out.collect():
        taken[r.source] += size(r.text)
    for r in plan:
        assert abs(taken[r.source] - r.target) <= 9
    assert Counter(map(str, out.collect())) == Counter(map(str, mixing.mix(corpus.crowded(docs).repartition(7)).collect()))
    assert mixing.mix(corpus.empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    corpus.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)))
        steps.append(docs)
    good = {r.doc_id for r in steps[0].collect()}
    assert {0, 1, 5, 2000} <= good and not {3000, 3001, 3004, 3007} & good
    one = Counter(r.doc_id for r in steps[1].collect())
    assert max(one.values()) == 1 and 1000 not in one and 2000 not in one and 5 in one
    assert Counter(r.doc_id for r in steps[2].collect()) == one
    assert all(d.columns == corpus.frame(spark).columns for d in steps[:4])
    want = Counter(r.doc_id for r in steps[3].collect())
    assert Counter(r.doc_id for r in steps[4].collect()) == want and max(want.values()) <= 3
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in steps[4].collect())
