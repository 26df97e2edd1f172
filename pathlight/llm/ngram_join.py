"""N-gram Jaccard join by vertical partitioning (operator 3).

A document is the set of its distinct 5-word shingles as 64-bit hashes. One global order
of shingles, frequent ones last, serves twice:

- Candidates: two sets with Jaccard similarity of at least 0.75 share a shingle among the
  first n - ceil(0.75 n) + 1 of each. Those rows are dealt by shingle. Within a shingle,
  rows meet a few hubs first; only sets that are still in different components after that
  meet each other, so a group of m near copies costs m pairs, not m squared. The place of
  a shared shingle in both sets bounds their overlap, which drops most other pairs.
- Overlaps: the order's hash range is cut into FRAGMENTS. Partial overlaps of a pair are
  counted fragment by fragment and summed per pair, so long texts are dealt out too. The
  first fragment alone, as 32-bit hashes, bounds the sum, and most false pairs end there.
  Sets that share a very common shingle are compared in blocks, whose partial overlaps a
  task adds up fragment by fragment without a row for each pair.

The result is exact: hubs and bounds only spare work. Equal sets are one class from the
start, found by a 64-bit fingerprint of the set. Frequencies come from a sketch of fixed
size over all documents; it only orders shingles, so its errors cost time, not links.

Null and empty texts have no shingles and are linked with nothing: their component is
their own doc_id. Rows without doc_id link as any other and take the smallest doc_id of
their component, null if it has none. Rows that repeat, or share a doc_id, each get a row.
An empty table gives an empty result. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.llm.common import bytes_of, discard, documents, materialize, mix, rolling, slices, text_or_empty, trimmed, words

K = 5
#: Least similarity in percent.
LEAST = 75
#: Parts that the hash range is cut into; a power of two.
FRAGMENTS = 4
#: Counters of the frequency sketch, bits of the filter of candidates, and rows that these are cut into.
SKETCH, FILTER, CUTS = 1 << 22, 1 << 24, 256
#: Shingles that a task counts into its sketch at once; a task's counters stop at 255.
COUNTED = 2_000_000
#: Sets that begin with a shingle, up to which all its pairs are formed; beyond it they are compared in blocks.
FEW = 64
#: Sets and shingles of a block, on average; shingles counted at once.
IN_BLOCK, BLOCK_SHINGLES, STRETCH = 1024, 1 << 19, 2048
#: Hubs that a group of near copies meets.
HUBS = 4
#: Fingerprints that a task remembers so as not to repeat the rows of exact copies.
REMEMBERED = 200_000


def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the rows that have a word."""
    data, offsets = bytes_of(batch.column("text"))
    first, hashes, _, _ = words(data, offsets)
    begin, rolled = rolling(first, hashes, K)
    counts = np.diff(first)
    for row in np.flatnonzero(counts):
        if counts[row] >= K:
            h = np.sort(rolled[begin[row] : begin[row + 1]])
            if len(h) > 1:
                new = np.empty(len(h), bool)
                new[0] = True
                np.not_equal(h[1:], h[:-1], out=new[1:])
                h = h[new]
        else:
            n = int(counts[row])
            h = rolling(np.array([0, n]), hashes[first[row] : first[row] + n], n)[1]
        yield int(row), h


def fingerprint(h: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix(h * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(mix(np.array([total]))[0].view(np.int64))


MEMBERS = "doc_id bigint, own bigint, n int, sid bigint, cut int, counts binary"
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("cut", pa.int32()), ("counts", pa.binary())])


def members_and_sketch(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, own, n, sid), own being the hash of its text, and after them the rows (cut, counts) of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = np.zeros(SKETCH, np.uint8), []
        some = False

        def count() -> None:
            at, now = np.unique((np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.uint32), return_counts=True)
            sketch[at] = np.minimum(sketch[at] + np.minimum(now, 255).astype(np.uint16), 255)
            held.clear()

        for whole in batches:
            for batch in slices(whole):
                n, sid = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                for row, h in sets_of(batch):
                    n[row], sid[row] = len(h), fingerprint(h)
                    held.append(h)
                    some = True
                if sum(map(len, held)) >= COUNTED:
                    count()
                none = pa.nulls(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(n), pa.array(sid, mask=n == 0), none.cast(pa.int32()), none.cast(pa.binary())], schema=_MEMBERS)
        if some:
            if held:
                count()
            yield cut_rows(sketch, _MEMBERS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("own"), text_or_empty().alias("text")).mapInArrow(trimmed(run), MEMBERS)


def cut_rows(values: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    own = {"cut": pa.array(range(CUTS), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(values, CUTS)], pa.binary())}
    return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(CUTS).cast(f.type)) for f in schema], schema=schema)


def combined(rows: DataFrame, kind: type, how: Callable[..., np.ndarray]) -> np.ndarray:
    """The tasks' arrays of bytes as one array of fixed size; each cut reads them as a stream. Only that one comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = cut = None
        for batch in batches:
            cut = batch.column("cut")[:1]
            for x in batch.column("counts"):
                a = np.frombuffer(x.as_buffer(), np.uint8).astype(kind)
                out = a if out is None else how(out, a, out=out)
        yield pa.RecordBatch.from_arrays([cut, pa.array([out.tobytes()], pa.binary())], ["cut", "counts"])

    found = rows.filter("cut IS NOT NULL").select("cut", "counts").groupBy("cut").applyInArrow(run, "cut int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], kind) for r in sorted(found, key=lambda r: r["cut"])]) if found else np.empty(0, kind)


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """By counter: 0 where the count is within what other shingles add by chance, else the octave of the excess."""
    if not len(sketch):
        return np.zeros(SKETCH, np.uint8)
    noise = float(sketch.mean())
    least = noise + 6 * noise**0.5 + 4
    out = np.zeros(len(sketch), np.uint8)
    for octave in range(40):
        out[sketch > least + 2**octave] = octave + 1
    return out


def first_shingles(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(token, sid, n, pos): the first shingles of every set in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                sids, ns, tokens = [], [], []
                for _, h in sets_of(batch):
                    if (sid := fingerprint(h)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    n = len(h)
                    most = n + (-LEAST * n // 100) + 1  # n - ceil(LEAST% of n) + 1
                    c = classes[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
                    tokens.append((h[np.argsort(c, kind="stable")[:most]] if c.any() else h[:most]).view(np.int64))
                    sids.append(sid)
                    ns.append(n)
                ends = np.cumsum([0, *map(len, tokens)])
                values = pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["sid", "n", "tokens"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(trimmed(run), "sid bigint, n int, tokens array<bigint>")
    return rows.select("sid", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "sid", "n", "pos")


BUCKETS = "token bigint, hub bigint, hub_n int, hub_pos int, sid bigint, n int, pos int"


def buckets(tokens: DataFrame) -> DataFrame:
    """The rows of shingles that two sets or more begin with, each beside the shingle's hub. Reads sorted rows as they come and holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # token, sid, hub, hub_n, hub_pos of the row before
        sent = None  # the last shingle whose hub has been written
        for batch in batches:
            if not batch.num_rows:
                continue
            token, sid, n, pos = (batch.column(c).to_numpy() for c in ("token", "sid", "n", "pos"))
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            same = np.zeros(len(token), bool)
            same[1:] = ~new[1:] & (sid[1:] == sid[:-1])
            if last is not None and token[0] == last[0]:
                new[0], same[0] = False, sid[0] == last[1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            hub, hub_n, hub_pos = sid[at], n[at], pos[at]
            if (carried := at < 0).any():
                hub, hub_n, hub_pos = np.where(carried, last[2], hub), np.where(carried, last[3], hub_n), np.where(carried, last[4], hub_pos)
            keep = np.flatnonzero(~new & ~same)
            last = (token[-1], sid[-1], hub[-1], hub_n[-1], hub_pos[-1])
            if not len(keep):
                continue
            second = np.ones(len(keep), bool)
            second[1:] = token[keep[1:]] != token[keep[:-1]]
            second[0] = sent is None or token[keep[0]] != sent
            sent = token[keep[-1]]
            first = keep[second]
            rows = np.concatenate([keep, first])
            of = lambda own, hubs: np.concatenate([own[keep], hubs[first]])
            columns = (token[rows], hub[rows], hub_n[rows], hub_pos[rows], of(sid, hub), of(n, hub_n), of(pos, hub_pos))
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in BUCKETS.split(", ")])

    by = F.xxhash64(F.col("sid"), F.pmod(F.col("token"), F.lit(HUBS)))
    return tokens.repartition("token").sortWithinPartitions("token", by, "sid").mapInArrow(trimmed(run), BUCKETS)


def may_link(n: str, pos: str, m: str, qos: str):
    """Whether two sets that share a shingle at these places can be similar enough: sizes first, then the most that they can share."""
    n, pos, m, qos = map(F.col, (n, pos, m, qos))
    fits = 100 * F.least(n, m) >= LEAST * F.greatest(n, m)
    most = F.least(pos, qos) + 1 + F.least(n - pos, m - qos) - 1
    return fits & (100 * most >= LEAST * (n + m - most))


def shingle_sets(docs: DataFrame, wanted: np.ndarray, parts: int) -> DataFrame:
    """(sid, part, hashes) of the documents that the filter of candidates lets through, by so many parts of the hash range."""
    edges, shift = np.arange(parts + 1, dtype=np.uint64), np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, sets in wanted_sets(batches, wanted):
            cuts = [np.searchsorted(h >> shift, edges) for h in sets]
            lens = np.concatenate([np.diff(c) for c in cuts])
            hashes = np.concatenate(sets).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lens]), pa.int32()), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sids, parts)), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(sids))), lists], ["sid", "part", "hashes"]).filter(pa.array(lens > 0))

    return texts(docs).mapInArrow(trimmed(run), "sid bigint, part int, hashes array<bigint>")


def heads(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(sid, size, lost, hashes): of each such document's first fragment the number of shingles, their hashes as 32 bits, and how many of these coincide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, sets in wanted_sets(batches, wanted):
            own = [h[: np.searchsorted(h >> np.uint64(64 - (FRAGMENTS.bit_length() - 1)), 1)] for h in sets]
            short = [np.unique(h.astype(np.uint32)) for h in own]
            size, kept = np.array([len(h) for h in own], np.int32), np.array([len(h) for h in short], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *kept]), pa.int32()), pa.array(np.concatenate(short).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(size), pa.array(size - kept), lists], ["sid", "size", "lost", "hashes"])

    return texts(docs).mapInArrow(trimmed(run), "sid bigint, size int, lost int, hashes array<int>")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("doc_id"), text_or_empty().alias("text"))


def wanted_sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Fingerprints and sets of the documents that the filter of candidates lets through, by slices; a set that repeats in a slice comes once."""
    for whole in batches:
        at, bit = filter_bits(whole.column("doc_id").to_numpy())
        for batch in slices(whole.filter(pa.array(wanted[at] >> bit & 1 > 0))):
            sets = {fingerprint(h): h for _, h in sets_of(batch)}
            if sets:
                yield np.array(list(sets), np.int64), list(sets.values())


def filter_bits(doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the filter holds these documents: bytes, and bits in them."""
    k = mix(doc_ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER - 1)
    return (k >> np.uint64(3)).astype(np.int64), (k & np.uint64(7)).astype(np.uint8)


def candidate_filter(candidates: DataFrame) -> np.ndarray:
    """The bits of doc_id, by bytes. A document too many only costs its set's computation: pairs name what is compared."""
    schema = pa.schema([("cut", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(FILTER >> 3, np.uint8), False
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            if len(ids):
                some = True
                at, bit = filter_bits(ids)
                np.bitwise_or.at(bits, at, np.uint8(1) << bit)
        if some:
            yield cut_rows(bits, schema)

    found = combined(candidates.select("doc_id").mapInArrow(run, "cut int, counts binary"), np.uint8, np.bitwise_or)
    return found if len(found) else np.zeros(FILTER >> 3, np.uint8)


def similar(shared: Column) -> Column:
    return 100 * shared >= LEAST * (F.col("na") + F.col("nb") - shared)


def of_both(pairs: DataFrame, sets: DataFrame, on: list[str]) -> DataFrame:
    """pairs beside what sets say of b (as y_...) and of a (as x_...)."""
    rest = [c for c in sets.columns if c not in ("sid", "part")]
    side = lambda end, mark: sets.select(F.col("sid").alias(end), *on, *[F.col(c).alias(f"{mark}_{c}") for c in rest])
    return pairs.join(side("b", "y"), ["b", *on]).join(side("a", "x"), ["a", *on])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that can be similar by what they share of the first fragment. Equal 32-bit hashes can hide a shared shingle where they coincide within a set, so these count as shared."""
    shared = F.size(F.array_intersect("x_hashes", "y_hashes")) + F.least("x_lost", "y_lost")
    return of_both(pairs, sets, []).filter(similar(shared + F.least(F.col("na") - F.col("x_size"), F.col("nb") - F.col("y_size")))).select("a", "b", "na", "nb").distinct()


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) with what they share: partial overlaps by fragment, summed per pair. Documents that stand in for a set twice count once."""
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    part = of_both(each, sets, ["part"]).groupBy("a", "b", "na", "nb", "part").agg(F.max(F.size(F.array_intersect("x_hashes", "y_hashes"))).alias("_s"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("_s").alias("shared"))


def linked(docs: DataFrame, stand: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: by what the first fragment allows, then by the sum over all fragments. stand: the document (doc_id) that stands for each sid."""

    def wanted(of: DataFrame) -> np.ndarray:
        ids = of.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        return candidate_filter(stand.join(ids, "sid"))

    first = materialize(heads(docs, wanted(pairs)))
    left = materialize(possible(pairs, first))
    discard(first)
    sets = materialize(shingle_sets(docs, wanted(left), FRAGMENTS))
    out = materialize(overlaps(left, sets).filter(similar(F.col("shared"))).select("a", "b"))
    discard(left, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that edges (a, b) name: each step ties nodes to smaller ones, first over all neighbours, then over the smaller ones, until nothing changes."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(small.filter("a <> b").distinct())
        discard(edges)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0])
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def rooted(rows: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`: the root of the node in `column`, or the node itself."""
    of = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(of, rows[column] == of["_n"], "left").withColumn(out, F.coalesce("_r", column)).drop("_n", "_r")


def few_by_few(docs: DataFrame, stand: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) between components, from shingles that few sets begin with: all pairs of different components, but those tried before."""
    other = rows.select("token", *[F.col(c).alias(f"{c}_") for c in ("sid", "n", "pos", "root")])
    near = (F.col("root") != F.col("root_")) & (F.col("sid") < F.col("sid_")) & may_link("n", "pos", "n_", "pos_")
    rest = rows.join(other, "token").filter(near)
    rest = rest.groupBy(F.col("sid").alias("a"), F.col("sid_").alias("b"), F.col("n").alias("na"), F.col("n_").alias("nb"), F.col("root").alias("ra"), F.col("root_").alias("rb"))
    rest = rest.agg(F.lit(1).alias("_1")).drop("_1")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"))
    links = linked(docs, stand, rest.select("a", "b", "na", "nb"))
    out = materialize(links.join(rest.select("a", "b", "ra", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    discard(rest, links)
    return out


def many_by_blocks(docs: DataFrame, stand: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between components, from shingles that many sets begin with.

    All sets that share a hub are cut into blocks of bounded sets and shingles. Each pair of
    blocks is read as a stream, fragment by fragment: a matrix product counts what their sets
    share of a fragment, and the sums over all fragments name one link for each two
    components. No pair becomes a row before it is a link.
    """
    group = rows.groupBy("hub", "sid", "n", "root").agg(F.lit(1).alias("_1"))
    count = group.groupBy("hub").agg(F.count("*").alias("_m"), F.sum("n").alias("_s"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi")
    count = count.select("hub", F.greatest(F.ceil(F.col("_m") / IN_BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int").alias("_k"))
    placed = materialize(group.join(count, "hub").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("_k")).cast("int")))
    sets = materialize(shingle_sets(docs, candidate_filter(stand.join(placed.select("sid").distinct(), "sid")), FRAGMENTS).dropDuplicates(["sid", "part"]))
    out = materialize(by_blocks(placed, sets, Cell))
    discard(placed, sets)
    return out


def by_blocks(placed: DataFrame, sets: DataFrame, kind: type[Cell]) -> DataFrame:
    """What pairs of blocks of a hub find, each read as a stream. placed: hub, sid, n, root, block, and _k, the hub's blocks; sets: sid, part, hashes."""
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    cells = placed.withColumn("_o", other).select("hub", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "sid", "n", "root")
    roster = cells.withColumn("part", F.lit(-1)).withColumn("hashes", F.lit(None).cast("array<bigint>"))
    pieces = cells.select("hub", "i", "j", "sid").distinct().join(sets, "sid")
    stream = roster.unionByName(pieces, allowMissingColumns=True).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "part")
    rows = stream.select("hub", "i", "j", "part", "block", "sid", "n", "root", "hashes")
    return rows.mapInArrow(trimmed(lambda batches: compared(batches, kind)), "a bigint, b bigint").distinct()


class Cell:
    """Two blocks of sets (one, if i = j) and what their sets have shared so far."""

    def __init__(self, rows: pa.RecordBatch):
        self.key = tuple(rows.column(c)[0].as_py() for c in ("hub", "i", "j"))
        self.rows, self.part, self.held = [rows], None, []

    def roster(self) -> None:
        sid, n, root, block = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in self.rows]) for c in ("sid", "n", "root", "block"))
        self.rows = []
        self.sides = []
        for b in self.key[1:]:
            own, first = np.unique(sid[block == b], return_index=True)
            self.sides.append((own, n[block == b][first].astype(np.int64), root[block == b][first]))
        self.total = np.zeros([len(s[0]) for s in self.sides], np.float32)

    def add(self, rows: pa.RecordBatch, part: int) -> None:
        if part == -1:
            self.rows.append(rows)
            return
        if part != self.part:
            self.count()
            self.part = part
        self.held.append(rows)

    def count(self) -> None:
        """Adds what the sets share of the fragment that has been read."""
        if self.rows:
            self.roster()
        if not self.held:
            return
        sid = np.concatenate([r.column("sid").to_numpy() for r in self.held])
        lens = np.concatenate([r.column("hashes").value_lengths().to_numpy() for r in self.held])
        keys, col = np.unique(np.concatenate([r.column("hashes").flatten().to_numpy() for r in self.held]), return_inverse=True)
        self.held = []
        # only shingles of two sets or more can be shared; a stretch of them at a time
        shared = np.bincount(col, minlength=len(keys)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[col]
        row, col = np.repeat(np.arange(len(sid)), lens)[keep], number[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        places = []
        for own, _, _ in self.sides:
            at = np.minimum(np.searchsorted(own, sid), max(len(own) - 1, 0))
            places.append(np.where(own[at] == sid, at, -1) if len(own) else np.full(len(sid), -1))
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, STRETCH):
            a, b = np.searchsorted(col, [low, low + STRETCH])
            sides = []
            for p, size in zip(places, self.total.shape, strict=True):
                m = np.zeros((size, STRETCH), np.float32)
                r = p[row[a:b]]
                m[r[r >= 0], col[a:b][r >= 0] - low] = 1
                sides.append(m)
            self.total += sides[0] @ sides[1].T

    def links(self) -> pa.RecordBatch:
        self.count()
        (_, n, ra), (_, m, rb) = self.sides
        ok = (100 * self.total >= LEAST * (n[:, None] + m[None, :] - self.total)) & (ra[:, None] != rb[None, :])
        x, y = np.nonzero(ok)
        found = np.unique(np.sort(np.stack([ra[x], rb[y]], 1), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])


def compared(batches: Iterator[pa.RecordBatch], kind: type[Cell]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of each cell. Rows come sorted by cell and fragment, a cell's sets first (as fragment -1)."""
    cell = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("hub", "i", "j", "part")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            rows = batch.slice(int(a), int(b - a))
            if cell is None or tuple(keys[a, :3].tolist()) != cell.key:
                if cell is not None:
                    yield cell.links()
                cell = kind(rows)
            else:
                cell.add(rows, int(keys[a, 3]))
    if cell is not None:
        yield cell.links()


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, own, n and sid of every row of docs; and for each sid, `first`, its first row (doc_id, own) where null doc_ids come last, and `top`, its component."""
    found = materialize(members_and_sketch(docs))
    members = materialize(found.filter("cut IS NULL").select("doc_id", "own", "n", "sid"))
    classes = frequency_classes(combined(found, np.uint32, np.add))
    discard(found)
    met = materialize(buckets(first_shingles(docs, classes)))
    stand = materialize(members.filter("n > 0").groupBy("sid").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc_id")))
    meet = met.filter(F.col("hub") != F.col("sid")).filter(may_link("n", "pos", "hub_n", "hub_pos"))
    pairs = materialize(meet.select(F.col("hub").alias("a"), F.col("sid").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb")).distinct())
    links = linked(docs, stand, pairs)
    roots = components(links)

    # what hubs did not join meets all others of its shingle that are in another component
    named = materialize(rooted(met.select("token", "hub", "sid", "n", "pos"), roots, "sid", "root"))
    discard(met, links)
    size = named.groupBy("token").agg(F.count("*").alias("_size"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("token", "_size")
    rows = materialize(named.join(size, "token"))
    discard(named)
    few, many = few_by_few(docs, stand, rows.filter(F.col("_size") <= FEW), pairs), many_by_blocks(docs, stand, rows.filter(F.col("_size") > FEW))
    upper = components(few.unionByName(many))
    discard(rows, pairs, stand, few, many)

    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    classed = members.filter("n > 0").groupBy("sid").agg(F.min(row).alias("first"))
    return members, rooted(rooted(classed, roots, "sid", "root"), upper, "root", "top")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    members, classed = classes_of(docs)
    least = classed.groupBy("top").agg(F.min("first.doc_id").alias("component_id"))
    named = classed.select("sid", "top").join(least, "top").select(F.col("sid").alias("_sid"), "component_id")
    out = members.join(named, members["sid"] == named["_sid"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (null ones last), and of texts that share it the one with the smallest hash. A row that repeats stays once. Rows without shingles all stay."""
    _, classed = classes_of(docs.select("doc_id", "text"))
    kept = classed.groupBy("top").agg(F.min("first").alias("_f")).select(F.col("_f.doc_id").alias("_id"), F.col("_f.own").alias("_hash"))
    bare = ~text_or_empty().rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn("_own", F.xxhash64(text_or_empty()))
    named = rows.filter(~bare).join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi")
    first = named.withColumn("_one", F.row_number().over(one_per("doc_id", "_own"))).filter("_one = 1").drop("_one")
    return first.unionByName(rows.filter(bare)).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_per(*columns: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*columns).orderBy(columns[-1])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir).select("doc_id", "text"))
