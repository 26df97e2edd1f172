"""BPE encoding and decoding (operator 5).

A priority queue holds (merge rank, position) of neighbouring symbols in a doubly
linked list. The lowest rank merges first; an entry whose symbols have since merged
is stale and skipped. Decoding concatenates vocabulary strings. Words repeat, so each
worker keeps a bounded table of finished words.

Null and empty texts have no tokens (the digest of the empty string). Ties of rank merge
left to right. Repeated rows give repeated results, an empty table an empty one. Columns
beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pathlight.llm.common import documents, text_or_empty

#: Entries of each table of finished words before its older half goes.
CACHE_WORDS = 300_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


#: Characters that Python splits at and the pattern's white space lacks.
ODD = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")


class Memory(dict):
    """A table of the last entries made: when it is full, the older half goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def get(self, key, default=None):
        out = super().get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self[key] = out
        return out

    def __setitem__(self, key, value):
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            super().__setitem__(key, value)


class WordBpe:
    """A tokenizer read from a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids |= self.added
        self.strings = {i: s for s, i in self.ids.items()}
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self.words = Memory(None)
        self.chunks = Memory(self.chunk)

    def merged(self, word: str) -> list[str]:
        """The symbols that a word's merges leave."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.suffix
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if (r := ranks.get((parts[i], parts[i + 1]))) is not None:
                heap.append((r, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # stale: one of the two has merged since
            parts[i], parts[j] = a + b, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def word(self, word: str) -> tuple[str, str, int]:
        """(ids, strings, count) of one word of the split pattern."""
        out = self.words.get(word)
        if out is None:
            tokens = [t for t in self.merged(word) if t in self.ids]
            out = self.words[word] = (" ".join([str(self.ids[t]) for t in tokens]), " ".join(tokens), len(tokens))
        return out

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        """The same of lower-case text; no match of the pattern crosses white space."""
        found = [x for x in map(self.word, self.pattern.findall(chunk)) if x[2]]
        if len(found) == 1:
            return found[0]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        """(ids, strings, count) of each stretch between spaces or special token, in order."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special and "<|" in text else (text,)):
            if k % 2:
                out.append((str(self.added[part]), part, 1))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            known = self.chunks
            out += [known[c] for c in (SPACES.split(part.lower()) if ODD.search(part) else part.lower().split())]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, n in self.pieces(text) if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own, a vocabulary's strings join by one space."""
        return " ".join(self.strings[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def digests(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    found = [x for x in bpe.pieces(text) if x[2]]
    sha = lambda k: hashlib.sha256(" ".join([x[k] for x in found]).encode()).hexdigest()
    return sum([x[2] for x in found]), sha(0), sha(1)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, with the file that workers have at `vocabulary`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            found = [digests(bpe, x.as_py()) for x in batch.column("text")]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(x.as_py()) for x in batch.column("text")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), vocabulary_path())
