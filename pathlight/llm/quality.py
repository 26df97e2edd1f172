"""Quality rules as a short-circuit cascade (operator 8), built-in functions only.

Every rule is a predicate over measures of a text. `ordered` estimates each rule's cost
and rejection rate on a bounded sample and sorts the rules by rejection per cost;
`rejected_by` is one CASE in that order, so a text that an early rule rejects never pays
for a later one. A text's words are made once for all rules. The verdict does not depend on
the order, only the work does. Windows of words are told apart by a 64-bit hash.

A null or empty text has no words and is rejected for that. Repeated rows get equal
results, an empty table an empty one; columns of other names pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.llm.common import discard, documents, materialize, text_or_empty

#: Rows of the sample that costs and rejection rates are estimated on, and how often each is evaluated for its cost.
SAMPLE_ROWS, REPEATS = 400, 6
MIN_WORDS = 50
#: Percent of words in repeated 3-word windows; symbols and exclamation marks per 100 words.
MOST_REPEATED, MOST_SYMBOLS, MOST_EXCLAIMED = 50, 40, 50
#: Percent of lines with a word that repeat an earlier one; percent of capitals in words.
MOST_DUP_LINES, MOST_CAPITALS = 60, 70
WORD_CHARS = (2, 40)

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(word: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sorts the windows by a 64-bit hash of their words, so n log n."""

    def marked(windows: Column) -> Column:
        twin = lambda x, i: F.coalesce(x["h"] == F.get(windows, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(windows, i - 1)["h"], F.lit(False))
        hit = F.filter(windows, twin)
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    n = F.size(word) - 2
    window = lambda i: F.struct(F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("h"), i.alias("i"))
    return F.when(n >= 2, let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), window)), marked)).otherwise(0)


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column, word: Column) -> dict[str, Column]:
    """Each measure as an expression over a text and its words."""
    return {
        "n_words": F.size(word).cast("long"),
        "word_chars": F.length(F.array_join(word, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(word).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_exclaimed": F.regexp_count(text, F.lit("!")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: The first two are the base: what they reject, the operator rejects.
RULES = [
    Rule("few_words", lambda m: m["n_words"] < MIN_WORDS),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > MOST_SYMBOLS * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > MOST_DUP_LINES * m["n_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < WORD_CHARS[0] * m["n_words"]) | (m["word_chars"] > WORD_CHARS[1] * m["n_words"])),
    Rule("capitals", lambda m: 100 * m["n_capitals"] > MOST_CAPITALS * m["word_chars"]),
    Rule("exclamations", lambda m: 100 * m["n_exclaimed"] > MOST_EXCLAIMED * m["n_words"]),
]


def _rejects(rule: Rule, text: Column) -> Callable[[Column], Column]:
    return lambda word: rule.rejects(measures(text, word))


def sample_of(docs: DataFrame, text: str) -> DataFrame:
    """SAMPLE_ROWS texts by the smallest hashes of all rows; a first cut by the hash spares sorting the rest."""
    rows = docs.select(text_or_empty(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    share = min(1.0, 4 * SAMPLE_ROWS / max(docs.count(), 1))
    return rows.filter(F.pmod("_h", F.lit(1_000_000)) < int(1_000_000 * share) + 1).orderBy("_h").limit(SAMPLE_ROWS).select("_t")


def ordered(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> list[Rule]:
    """The rules by rejection per second, highest first, as a sample shows them.

    A rule's cost is the time of evaluating it on the sample REPEATS times, less that of the words alone, which all rules share.
    """
    sample = materialize(sample_of(docs, text))
    spread = sample.repartition(1).select("_t", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_r"))
    t = F.col("_t")
    shares = sample.agg(*[F.avg(let(words(t), _rejects(r, t)).cast("int")).alias(r.name) for r in rules]).collect()[0]

    def seconds(rejects: Callable[[Column], Column]) -> float:
        run = spread.select(let(words(t), rejects).alias("x"))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            run.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    alone = seconds(lambda w: F.size(w) < 0)

    def worth(rule: Rule) -> float:
        return (shares[rule.name] or 0.0) / max(seconds(_rejects(rule, t)) - alone, alone / 100)

    out = [r for _, r in sorted(((-worth(r), r) for r in rules), key=lambda x: (x[0], x[1].name))]
    discard(sample)
    return out


def rejected_by(rules: list[Rule], found: dict[str, Column]) -> Column:
    """The first rule in this order that rejects a text, or null; later ones are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(found), F.lit(rule.name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    order, t = ordered(docs, text=text), text_or_empty(text)
    return docs.filter(let(words(t), lambda w: rejected_by(order, measures(t, w)).isNull()))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and kept. The measures are columns here, so the cascade adds only the others."""
    order = ordered(docs, text=text)
    made = docs.select(F.col("doc_id"), text_or_empty(text).alias("_t")).withColumn("_w", words(F.col("_t")))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = measures(F.col("_t"), F.col("_w"))
    out = made.select("doc_id", "_t", *[own[c].alias(c) for c in base])
    found = own | {c: F.col(c) for c in base}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), rejected_by(order, found).isNull().alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_exclaimed
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > {MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {MOST_DUP_LINES} * n_lines
            OR word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words
            OR 100 * n_capitals > {MOST_CAPITALS} * word_chars OR 100 * n_exclaimed > {MOST_EXCLAIMED} * n_words) AS kept
FROM b
"""
