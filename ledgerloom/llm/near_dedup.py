"""MinHash near-duplicates: odd sketches screen banded candidates, full shingle sets confirm them, links make components.

1. One pass over the texts: distinct 5-word shingles as 64-bit hashes, MinHash samples, their odd sketch and band keys.
2. Documents of one set become one node, the smallest id. Only nodes go on, so exact copies cost nothing more.
3. Nodes that share a band key are candidates. An odd sketch is the parity bitmap of the samples; the population count of two
   sketches' XOR estimates how many samples differ, and pairs beyond `sketch_limit` go. Of the pairs that stay, a bucket
   reports a spanning forest only, so what it emits is linear in its nodes. Components of these are clusters.
4. Every link lies within a cluster. There full sets are compared exactly, a node with all others at once over an inverted
   list, and again a spanning forest of the links is reported. Components of that are the result.
Buckets and clusters of any size are dealt in pairs of bounded blocks; a large one is tied to its smallest node first, so that
only what that leaves over is compared with all. Rows of hot keys are joined by broadcast. Components come of alternating large
and small stars, each round written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, slices, table

SHINGLE = 5
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
#: Nodes of a bucket that one task compares with each other or with as many more.
BLOCK_NODES = 4096
#: Shingles of a cluster's nodes that one task compares with each other or with as many more; one node may have more.
BLOCK_SHINGLES = 1 << 20
#: Nodes whose sketches are compared with a block at once.
STRIP = 128
#: Bits of the map that screens whose full sets are wanted: 16 for each, up to this bound (16 MB), beyond which it only screens less.
MAP_BITS = 1 << 27

#: Keys that are broadcast at most, and the rows that a key has at least for that.
HOT_KEYS, LEAST_HOT = 100_000, 1000
#: Text bytes that are hashed at once.
SLICE = 1 << 20

_U64, _U32 = np.uint64, np.uint32


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


_BYTES = _stream(11, 256)
_BASE = 0xD1342543DE82EF95
_MULTIPLY = (_stream(12, SAMPLES) >> _U64(32)).astype(_U32) | _U32(1)
_FLIP = (_stream(13, SAMPLES) >> _U64(32)).astype(_U32)
_BAND_WEIGHTS = _stream(14, ROWS) | _U64(1)
_BAND_SALT = _stream(15, BANDS)
_BIT_SALT = _stream(16, SAMPLES)
_PLACE = _stream(17, SHINGLE) | _U64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_NEAR_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, _BASE, np.uint64)))


def _power(place: np.ndarray) -> np.ndarray:
    """_BASE to the power of each place in a word, of two tables: the second is as long as the longest word needs."""
    far = int(place.max(initial=0)) >> 16
    if not far:
        return _NEAR_POWERS[place]
    step = pow(_BASE, 1 << 16, 1 << 64)
    return _NEAR_POWERS[place & 0xFFFF] * np.multiply.accumulate(np.append(np.uint64(1), np.full(far, step, np.uint64)))[place >> 16]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: word hashes by sums over their bytes, then runs of five.

    Fewer words than five: the whole sequence, as one. No words: empty. "Full sets" are these: two shingles count as one if their
    hashes agree.
    """
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[joined]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    sizes = np.flatnonzero(space & ~before) - starts
    held = np.flatnonzero(~space)
    place = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    parts = _BYTES[joined[held]] * _power(place)
    sums = np.add.reduceat(parts, np.cumsum(sizes) - sizes) if len(starts) else parts
    words = _mix(sums + sizes.astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
    limits = np.cumsum([len(d) + 1 for d in data])
    first = np.searchsorted(starts, np.concatenate([[0], limits[:-1]]))
    last = np.append(first[1:], len(starts))
    runs = np.zeros(len(words), np.uint64)
    n = len(words) - SHINGLE + 1
    if n > 0:
        for j in range(SHINGLE):
            runs[:n] += words[j : j + n] * _PLACE[j]
        runs = _mix(runs)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U64(b - a)))
        else:
            out.append(words[:0])
    return out


def samples_of(shingles: np.ndarray) -> np.ndarray:
    x, best = (shingles >> _U64(32)).astype(_U32), None
    for i in range(0, len(x), 2048):
        least = ((x[i : i + 2048, None] ^ _FLIP) * _MULTIPLY).min(0)
        best = least if best is None else np.minimum(best, least)
    return best


def sketch_of(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    place = _mix(samples.astype(np.uint64) ^ _BIT_SALT) >> _U64(64 - SKETCH_BITS.bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


def bands_of(samples: np.ndarray) -> np.ndarray:
    return _mix((samples.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_WEIGHTS).sum(1, dtype=np.uint64) + _BAND_SALT)


def sketch_limit(percent: int) -> int:
    """Differing bits that a pair at this similarity exceeds with negligible probability (seven deviations)."""
    differ = 1 - percent / 100
    flips, flips_sd = 2 * SAMPLES * differ, 2 * math.sqrt(SAMPLES * differ * (1 - differ))
    keep = (1 - 2 / SKETCH_BITS) ** flips
    odd = SKETCH_BITS / 2 * (1 - keep)
    sd = math.sqrt((flips_sd * keep) ** 2 + odd * (1 - odd / SKETCH_BITS))
    return min(SKETCH_BITS, math.ceil(odd + 7 * sd))


def sketch_similarity(differing: int) -> float:
    """The similarity that a count of differing bits suggests."""
    rest = max(1 - 2 * differing / SKETCH_BITS, 1 / SKETCH_BITS)
    return max(0.0, 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(rest))


_LONGS = T.ArrayType(T.LongType())
_SIGNATURE = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("sketch", _LONGS), T.StructField("bands", _LONGS)])


def _signatures():
    def work(texts):
        out = ([], [], [], [], [])
        for s in shingle_sets(texts):
            if len(s):
                found = samples_of(s)
                row = (len(s), int(_mix(s + _U64(1)).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s ^ _BYTES[0])).view(np.int64)), sketch_of(found).view(np.int64), bands_of(found).view(np.int64))
            else:
                row = (0, 0, 0, None, None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return list(out)

    return work


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents among nodes. No text is shuffled: a bit map of bounded size screens the scan first."""
    spark = texts.sparkSession
    bits = min(MAP_BITS, 1 << max(16, (16 * nodes.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    held = nodes.select((place("node") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    known = np.zeros(bits, bool)
    for r in held.collect():  # a row for each 32,768 bits
        found = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").view(bool)
        begin = 32_768 * (r["k"] - 1)
        known[begin : begin + 32_768] = found[: bits - begin]
    shared = spark.sparkContext.broadcast(np.packbits(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            picked = np.flatnonzero(wanted[batch.column(2).to_numpy()])
            if len(picked):
                for part in slices(batch.take(pa.array(picked)), ["text"], SLICE):
                    made = [x.view(np.int64) for x in shingle_sets(part.column(1).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    screened = texts.where("doc_id is not null").select("doc_id", "text", place("doc_id").alias("at")).mapInArrow(run, "node long, shingles array<long>")
    return screened.join(nodes.select("node"), "node", "left_semi")


def hot_join(rows: DataFrame, groups: DataFrame, key: list[str], members: str, total: int) -> DataFrame:
    """rows joined with groups: a row for each key, of which `members` says how many of the `total` rows have it.

    Keys of over total / HOT_KEYS rows (fewer than HOT_KEYS by that) are broadcast, so their rows stay where they are.
    """
    most = max(LEAST_HOT, total // HOT_KEYS)
    hot = groups.where(F.col(members) > most)
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col(members) <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of all nodes on edges (a, b): alternating large and small stars until the edges stay the same.

    A hub's edges meet its least neighbour in a join, of which adaptive execution splits the large side where a hub is hot.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        linked = both.join(least, "a")
        out = linked.where("b > a").select("b", "m") if large else linked.select("b", "m").unionAll(least.select("a", "m"))
        return out.toDF("a", "b").where("a <> b").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now, k = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0"), 0
    before, after = None, state(now)
    while after[0] and before != after:
        k += 1
        now = scratch.keep(star(star(now, True), False), f"{name}-{k}")
        before, after = after, state(now)
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionAll(stars.select("component", "component").distinct())


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and at != tuple(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            at = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Trees of a block's nodes; joining two reports an edge."""

    def __init__(self, node: np.ndarray):
        self.node, self.root, self.edges = node, np.arange(len(node)), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Tie i to one of `others` for each tree that they stand in."""
        roots, first = np.unique(self.root[others], return_index=True)
        for r, j in zip(roots.tolist(), others[first].tolist(), strict=True):
            if r != self.root[i]:
                a, b = int(self.node[i]), int(self.node[j])
                self.edges.append((min(a, b), max(a, b)))
                self.root[self.root == r] = self.root[i]


def _edge_batches(forests: Iterator[_Forest]) -> Iterator[pa.RecordBatch]:
    for forest in forests:
        for i in range(0, len(forest.edges), 50_000):
            a, b = zip(*forest.edges[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _blocks(rows: pa.Table) -> tuple[np.ndarray, int, bool]:
    """(order of the rows, the first block's before the second's; its size; whether two blocks meet)."""
    x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    second = rows.column("block").to_numpy() != x
    order = np.lexsort((rows.column("node").to_numpy(), second))
    return order, int((~second).sum()), x != y


def _screen(percent: int):
    """A spanning forest of the pairs of each bucket that size and sketch let through."""
    limit = sketch_limit(percent)

    def forest(rows: pa.Table) -> _Forest:
        order, split, crossed = _blocks(rows)
        node, sizes = rows.column("node").to_numpy()[order], rows.column("n").to_numpy()[order]
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_BITS // 64)[order]
        out = _Forest(node)
        for at in range(split if crossed else 1, len(node), STRIP):
            strip = slice(at, min(at + STRIP, len(node)))
            to = split if crossed else strip.stop - 1
            near = np.bitwise_count(sketch[strip, None] ^ sketch[:to]).sum(2, dtype=np.uint16) <= limit
            near &= 100 * np.minimum(sizes[strip, None], sizes[:to]) >= percent * np.maximum(sizes[strip, None], sizes[:to])
            for r in np.flatnonzero(near.any(1)).tolist():
                others = np.flatnonzero(near[r, : to if crossed else at + r])
                if len(others):
                    out.join(at + r, others)
        return out

    return lambda batches: _edge_batches(forest(rows) for rows in _grouped(batches, ["bucket", "x", "y"]))


def _confirm(percent: int):
    """A spanning forest of the links of each cluster, on full sets."""

    def forest(rows: pa.Table) -> _Forest:
        order, split, crossed = _blocks(rows)
        node = rows.column("node").to_numpy()[order]
        lists = rows.column("shingles").combine_chunks().take(pa.array(order))
        sizes = np.diff(lists.offsets.to_numpy())
        words, number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), sizes)
        listed = np.argsort(number, kind="stable")  # by shingle, then by node
        holders, begin = owner[listed], np.searchsorted(number[listed], np.arange(len(words) + 1))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = _Forest(node)
        for i in range(split if crossed else 1, len(node)):
            to = split if crossed else i
            if (out.root[:to] == out.root[i]).all():
                continue
            own = number[bounds[i] : bounds[i + 1]]
            many = begin[own + 1] - begin[own]
            place = np.arange(int(many.sum())) + np.repeat(begin[own] - np.cumsum(many) + many, many)
            common = np.bincount(holders[place], minlength=len(node))[:to]
            out.join(i, np.flatnonzero(100 * common >= percent * (sizes[:to] + sizes[i] - common)))
        return out

    return lambda batches: _edge_batches(forest(rows) for rows in _grouped(batches, ["bucket", "x", "y"]))


def _dealt(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """Each bucket's rows in blocks, and each pair of blocks that must be compared under a key (bucket, x, y) of its own.

    `size` is each row's weight, of which a block holds about `limit`; `total` and `rest_total` are those of the bucket and of its
    rows with `rest`. Rows without `rest` stand in one tree already: their blocks meet those of `rest` only.
    """
    tied, rest = (F.ceil(x / limit).cast("int") for x in (F.col("total") - F.col("rest_total"), F.col("rest_total")))
    rows = rows.withColumns({"tied": tied, "parts": rest})
    block = F.when(F.col("rest"), F.col("tied") + F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("tied", F.lit(1))))
    rows = rows.where("parts > 0").withColumn("block", block.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("rest"), F.lit(0)).otherwise(F.col("tied")), F.col("tied") + F.col("parts") - 1)))
    return rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("parts", "tied", "other", "total", "rest_total", "rest")


def _linked(rows: DataFrame, groups: DataFrame, size: str, limit: int, near, held: list[str], compare, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) that tie all nodes of a bucket that `compare` links: rows have bucket, node, total and the columns `held`;
    groups are a row for each bucket with its total and members.

    A bucket of one block is compared as it is. In a larger one, all rows are held against the smallest node first, by the
    column expression `near`: what it links is one tree, and pairs within it need no comparison. So copies of rows grow with a
    bucket of one family in proportion, and with the square only of what is left over.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = lambda pairs: pairs.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(compare, "a long, b long")
    big = F.col("total") > limit
    counted = groups.where(big).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    whole = lambda df: df.withColumns({"rest": F.lit(True), "rest_total": F.col("total")})
    if not counted:
        return compared(_dealt(whole(rows), size, limit))
    rows = scratch.keep(rows, f"{name}-rows")
    large = rows.where(big)
    hubs = large.groupBy("bucket").agg(F.min_by(F.struct("node", *held), "node").alias("hub")).join(groups.select("bucket", "members"), "bucket")
    judged = hot_join(large, hubs, ["bucket"], "members", counted).withColumn("rest", ~near & (F.col("node") != F.col("hub.node")))
    judged = scratch.keep(judged.withColumn("hub", F.col("hub.node")).drop("members"), f"{name}-judged")
    spare = judged.where("rest").groupBy("bucket").agg(F.sum(size).alias("rest_total")).join(groups.select("bucket", "members"), "bucket")
    left = hot_join(judged.drop("hub"), spare, ["bucket"], "members", counted).drop("members")
    tied = judged.where("NOT rest AND node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return compared(_dealt(whole(rows.where(~big)), size, limit).unionByName(_dealt(left, size, limit))).unionAll(tied)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Links: 100 * intersection >= percent * union of the full shingle sets, whatever the texts' lengths. Null, empty or wordless
    text: no shingles, no links, its own component. A null id: no links, component_id null, kept. Rows that repeat an id and a
    text are one node, so all of them have one component and `kept` where the id is the smallest; rows that repeat an id with
    different texts pool their links. Only the two named columns are read; others don't clash. An empty table: an empty result.
    Ids are 64-bit integers. Sets are of 64-bit hashes of shingles.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = ["n_shingles", "set_a", "set_b"]
    signed = scratch.keep(append_columns(texts, _SIGNATURE, ["text"], _signatures, limit=SLICE).drop("text"), "signatures")
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    classes = scratch.keep(linkable.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("members")), "classes")
    nodes = linkable.join(classes.select(*key, F.col("node").alias("doc_id")), [*key, "doc_id"], "left_semi")

    banded = nodes.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"))
    shared = scratch.keep(banded.groupBy("bucket").agg(F.count("*").alias("total")).where("total > 1"), "shared")
    in_all = shared.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    buckets = hot_join(banded, shared, ["bucket"], "total", in_all).join(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch"), "node")
    bits = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("hub.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    alike = (bits <= sketch_limit(percent)) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    maybe = _linked(buckets.withColumn("one", F.lit(1)), shared.withColumn("members", F.col("total")), "one", BLOCK_NODES, alike, ["n", "sketch"], _screen(percent), scratch, "buckets")
    clusters = scratch.keep(components(maybe, scratch, "maybe").select("node", F.col("component").alias("bucket")), "clusters")

    sets = _sets_of(texts, clusters)
    sized = clusters.join(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")), "node")
    sizes = scratch.keep(sized.groupBy("bucket").agg(F.sum("n").alias("total"), F.count("*").alias("members")), "sizes")
    in_all = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    full = hot_join(sized, sizes, ["bucket"], "members", in_all).drop("members").join(sets, "node")
    common = F.size(F.array_intersect("shingles", "hub.shingles"))
    alike = 100 * common >= percent * (F.col("n") + F.col("hub.n") - common)
    linked = _linked(full, sizes, "n", BLOCK_SHINGLES, alike, ["n", "shingles"], _confirm(percent), scratch, "clusters")
    labels = components(linked, scratch, "linked")

    labelled = classes.join(labels, "node", "left").select(*key, "members", F.coalesce("component", "node").alias("component_id"))
    in_all = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    placed = hot_join(signed.where("doc_id is not null and n_shingles > 0").select("doc_id", *key), labelled, key, "members", in_all).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id, doc_id = min(to_id) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
