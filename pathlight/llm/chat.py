r"""Chat formatting (operator 9), built-in functions only.

Layouts of training conversations differ: one row per turn, a `messages` array, `from` and
`value` pairs, instruction and output, prompt and completion. A layout's fingerprint is
the hash of its nested field paths; it selects a declared mapping into canonical turns
(conv_id, turn, role, text). Tables have one fingerprint, JSON lines one per row.

`formatted` writes the turns with a template. Control strings inside texts are escaped by
one backslash after their first character, those with k backslashes by one more, which is
undone exactly. The loss mask is a list of spans, one for each assistant text.

Null roles and texts count as empty, null turns come first, rows of equal turn go by role
and text, repeated rows are turns of their own. An unknown layout raises for a table, and
for a JSON line leaves the row out of the turns and in `unmapped`. Elements of an array may
lack fields that others have (null, so empty); an empty array is a conversation without turns. An empty table gives an
empty result; fields that no mapping names, clashing or not, are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"
#: A control string: its first character, backslashes of earlier escapes, and the rest.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])"


@dataclass(frozen=True)
class Mapping:
    """Paths that a layout has, paths that it may have, and how its turns read."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    array: str | None  # the field that lists the turns, with its role and text
    turns: tuple[tuple[str, str], ...]  # (role, text) fields; without an array, (constant role, field)


MAPPINGS = [
    Mapping("rows", ("conv_id", "turn", "role", "text"), (), None, ()),
    Mapping("messages", ("messages[].role", "messages[].content"), ("conv_id", "system"), "messages", (("role", "content"),)),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("conv_id", "system"), "conversations", (("from", "value"),)),
    Mapping("instruction", ("instruction", "output"), ("conv_id", "input", "system"), None, (("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt", ("prompt", "completion"), ("conv_id", "system"), None, (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("question", "answer"), ("conv_id", "system"), None, (("user", "question"), ("assistant", "answer"))),
]
#: Roles that layouts name differently.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
PATHS = sorted({p for m in MAPPINGS for p in m.needs + m.may})


def fingerprint(paths: set[str]) -> str:
    """Of the paths that any mapping names; others don't count."""
    return hashlib.sha256("\n".join(sorted(paths & set(PATHS))).encode()).hexdigest()


def registry() -> dict[str, Mapping]:
    out = {}
    for m in MAPPINGS:
        for n in range(len(m.may) + 1):
            for extra in combinations(m.may, n):
                out[fingerprint({*m.needs, *extra})] = m
    return out


REGISTRY = registry()


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The nested field paths of a type: a.b for structs, a[].b for arrays of structs."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def _role(role: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for a, b in ROLES.items():
        role = F.when(role == a, b).otherwise(role)
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turn_array(m: Mapping, field, has: set[str]) -> Column:
    """The turns of a record as an array; field(name) is the record's field."""
    if m.array:
        role, text = m.turns[0]
        out = F.transform(F.coalesce(field(m.array), F.array().cast(f"array<struct<{role}:string,{text}:string>>")), lambda x: _turn(x[role], x[text]))
    elif "input" in has:
        given = F.coalesce(field("input").cast("string"), F.lit(""))
        asked = F.concat(F.coalesce(field("instruction").cast("string"), F.lit("")), F.when(given == "", "").otherwise(F.concat(F.lit("\n\n"), given)))
        out = F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), field("output")))
    else:
        out = F.array(*[_turn(F.lit(r), field(c)) for r, c in m.turns])
    if "system" in has:
        said = F.coalesce(field("system").cast("string"), F.lit(""))
        out = F.concat(F.when(said == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(_turn(F.lit("system"), said))), out)
    return out


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of a table in any declared layout, which its schema's fingerprint selects."""
    paths = set(schema_paths(df.schema))
    m = REGISTRY.get(fingerprint(paths))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(paths & set(PATHS))}")
    if m.name == "rows":
        return df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = F.col("conv_id").cast("string") if "conv_id" in paths else F.lit(None).cast("string")
    turns = df.select(conv.alias("conv_id"), F.posexplode(_turn_array(m, F.col, paths)).alias("turn", "_x"))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("_x.role").alias("role"), F.col("_x.text").alias("text"))


def _under(prefix: str, keys: Column) -> Column:
    return F.transform(keys, lambda x: F.concat(F.lit(prefix), x))


def json_fingerprint(line: Column) -> Column:
    """The fingerprint of one JSON object's nested field paths: those of any element of an array, and of an empty array those that its layout needs."""
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.json_object_keys(line), none)
    for m in MAPPINGS:
        if m.array:
            items = F.from_json(F.get_json_object(line, f"$.{m.array}"), "array<string>")
            inner = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), none)))
            needed = F.array(*[F.lit(p) for p in m.needs])
            paths = F.concat(paths, F.when(F.size(items) == 0, needed).otherwise(F.coalesce(_under(f"{m.array}[].", inner), none)))
    kept = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, PATHS))))
    return F.sha2(F.array_join(kept, "\n"), 256)


def json_turns(lines: DataFrame, column: str = "value") -> DataFrame:
    """The canonical turns of JSON lines of mixed layouts, with conv_id as in the line or null."""
    marked = lines.select(F.col(column).alias("_j"), json_fingerprint(F.col(column)).alias("_f"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, m in REGISTRY.items():
        if m.name == "rows":
            continue
        has = next({*m.needs, *x} for n in range(len(m.may) + 1) for x in combinations(m.may, n) if fingerprint({*m.needs, *x}) == mark)
        tops = sorted({p.split("[")[0] for p in has})
        kinds = ", ".join(f"`{c}` " + (f"array<struct<`{m.turns[0][0]}`:string,`{m.turns[0][1]}`:string>>" if c == m.array else "string") for c in tops)
        record = F.from_json("_j", kinds)
        turns = F.when(F.col("_f") == mark, _turn_array(m, lambda c, r=record: r[c], has)).otherwise(turns)
    out = marked.select(F.get_json_object("_j", "$.conv_id").alias("conv_id"), F.posexplode(turns).alias("turn", "_x"))
    return out.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("_x.role").alias("role"), F.col("_x.text").alias("text"))


def unmapped(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines whose fingerprint no mapping has."""
    return lines.filter(~F.coalesce(json_fingerprint(F.col(column)), F.lit("")).isin(list(REGISTRY)))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def _escape_role(role: Column) -> Column:
    """Roles stand on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and mask: (turn index, start, end) of each text to learn, in code points of formatted, end exclusive."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    made = turns.select("conv_id", "turn", "role", "text", head.alias("_h"), escape(F.col("text")).alias("_b"))
    by = Window.partitionBy("conv_id").orderBy(*order)
    made = made.select(
        "conv_id",
        F.row_number().over(by).alias("_i"),
        (F.col("role") == LEARNT).alias("_learnt"),
        F.length("_h").cast("long").alias("_n"),
        F.length("_b").cast("long").alias("_m"),
        F.concat("_h", "_b", F.lit(CLOSE)).alias("_p"),
        F.sum(F.length("_h") + F.length("_b") + len(CLOSE)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
    )
    start = F.col("_to") - len(CLOSE) - F.col("_m")
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_p", F.when(F.col("_learnt"), start).alias("_s"), (start + F.col("_m")).alias("_e")))).alias("_x"))
    spans = F.transform(F.filter("_x", lambda x: x["_s"].isNotNull()), lambda x: F.struct((x["_i"] - 1).alias("turn"), x["_s"].alias("start"), x["_e"].alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("_x", lambda x: x["_p"]), "").alias("formatted"), spans.alias("mask"))


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, turns (role and text) and learnt texts, from formatted and its mask alone."""
    pieces = F.slice(F.split("formatted", OPEN.replace("|", r"\|"), -1), 2, 1 << 30)
    made = made.select("conv_id", "formatted", "mask", pieces.alias("_p"))
    cut = F.transform("_p", lambda p: F.struct(F.substring_index(p, "\n", 1).alias("head"), p.alias("piece")))
    made = made.select("conv_id", "formatted", "mask", cut.alias("_c"))
    text = lambda c: F.substr(c["piece"], F.length(c["head"]) + 2, F.length(c["piece"]) - F.length(c["head"]) - 1 - len(CLOSE))
    turns = F.transform("_c", lambda c: F.struct(_unescape_role(c["head"]).alias("role"), unescape(text(c)).alias("text"), (F.length(c["piece"]) + len(OPEN)).alias("size")))
    # a span's own turn holds it: the text before the turn need not be walked again
    size = lambda s: (s["end"] - s["start"]).cast("int")
    learnt = F.transform("mask", lambda s: unescape(F.substr(F.get("_c", s["turn"])["piece"], F.length(F.get("_c", s["turn"])["piece"]) - len(CLOSE) - size(s) + 1, size(s))))
    return made.select("conv_id", "formatted", "mask", turns.alias("turns"), learnt.alias("learnt"))


def digests(turns: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, in digests."""
    back = read_back(formatted(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds: texts that are themselves control strings.
HOSTILE = r"</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(HOSTILE).alias("text"))
    return digests(turns.unionByName(extra))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS body,
             regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
