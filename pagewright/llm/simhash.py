"""SimHash near-dedup with pivot distance tables.

Fingerprints. Words are lower-cased (A-Z) and cut into shingles; each shingle is hashed with XXH64
(seed 42), and a bit of the fingerprint is set if it is set in over half of the hashes, repeats
included. Fewer words than a shingle: one shingle of the whole sequence; none: zero.

Links. Two fingerprints within ``radius`` bits are linked. Equal fingerprints are collapsed first,
so copies never meet each other. The 64 bits are cut into blocks; two linked fingerprints agree on
all but ``radius`` of them, so each set of agreeing blocks is a key of an exchange. Nearly all keys
have SMALL rows at most, which are all compared. A key of over HOT rows is not gathered: its rows are
dealt again, by finer keys within it, of which linked fingerprints share one too. Within a key of more
than SMALL rows, a
table holds every fingerprint's Hamming distances to reference fingerprints (pivots): by the
triangle inequality linked fingerprints differ by ``radius`` at most in every coordinate, so rows
sorted by the first coordinate are cut to a band, those with a larger difference in another are
discarded, and only survivors are verified. A search visits each fingerprint once and drops what
it has reached, so that a dense group yields a spanning forest and never all of its pairs.

Similar texts. Fingerprints of 64 bits can't hold a similarity of 0.8 apart from 0.6, so
``similar_groups`` adds to these links, which it takes first if a radius is given, those of the sets of
each text's five-word shingles, between texts that are apart even so. Its keys can't miss: in any
fixed order of shingles, two sets of a similarity of 0.8 share one of their first fifths (and one
shingle more), at every size of the corpus. The order is from rare to common, by counts over a
sample of texts, which decides the cost and never the result. Within a key, pairs go whose sizes, or
the shingles left after the common one, or parities of the sets rule the similarity out; long sets,
which fill those parities, are held against longer ones. First each text meets its neighbours by size, and two of its pairs at most are verified on the whole sets; then
come pairs of all rows of a key that span what isn't in one component yet, and at last all pairs that
are still apart, so that a dense group doesn't yield all of its pairs. A link of sets is exact up to equal 64-bit
hashes.

Components. Minimum labels travel along the forest's edges with pointer jumping, in DataFrames that
are cut by checkpoints; nothing about single documents reaches the driver.

Nulls and empty texts have fingerprint zero and link like any other. Very long texts are read whole.
Rows without a key take part and get the component of their fingerprint. Repeated rows and ties need
no rule: the label is the smallest key. An empty table gives an empty result. Columns of other names
pass through (``near_groups``) and those named fp or component are replaced; ``similar_groups`` returns
its own columns alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, chunks, cut_batches, mapped, written

SEED = 42

#: Keys of so many rows at most compare all of them, which is a constant number of pairs a row.
SMALL = 8

#: Keys of fingerprints of more rows are cut into finer keys before their rows are compared.
HOT = 1 << 12

#: Of larger sets of similar texts, neighbours by size that are looked at first.
AROUND = 2

#: Reference fingerprints: hashes of small numbers, fixed so that every worker has the same.
N_PIVOTS = 16


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(n)], dtype=np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """Of one text's UTF-8 bytes, as a signed 64-bit number."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-1]]
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 16)]], dtype=">u8")
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """Adds fp (signed 64-bit) to the rows and takes text away."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    docs = docs.select(*(f.name for f in rest), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batches(batch, text):
                fps = pa.array([fingerprint(x, width) for x in chunks(part.column(text))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), fps], [*(f.name for f in rest), "fp"])

    return mapped(docs, run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def block_keys(n: int, radius: int) -> tuple[list[int], int]:
    """Masks of blocks, and how many of them must agree: so many that random fingerprints of n
    rows seldom share a key, while the number of keys a row stays moderate."""
    for blocks, agree in ((radius + 1, 1), (radius + 2, 2), (radius + 3, 3), (radius + 4, 4)):
        if agree * 64 // blocks >= np.log2(max(n, 1)) + 2 or agree == 4:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(held) for held in combinations(masks, agree)], agree


def distances(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the 64-bit words of a fingerprint."""
    return np.bitwise_count(rows ^ other).sum(-1, dtype=np.int16)


def forest(fps: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row) that span every component of the fingerprints of one key.

    fps: a row of 64-bit words for each fingerprint; refs: the pivots, alike."""
    if len(fps) == 2:
        return [(0, 1)] if int(distances(fps[0], fps[1])) <= radius else []
    table = distances(fps[:, None], refs[None])
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    alive = np.arange(len(fps))  # not reached yet, in order of the first coordinate
    edges, queue = [], []
    while queue or len(alive):
        if not queue:
            queue.append(int(alive[0]))
            alive = alive[1:]
        at = queue.pop()
        if not len(alive):
            break
        a, b = np.searchsorted(table[alive, 0], [table[at, 0] - radius, table[at, 0] + radius + 1])
        band = alive[a:b]
        if not len(band):
            continue
        some = np.flatnonzero((np.abs(table[band] - table[at]) <= radius).all(1))
        some = some[distances(fps[band[some]], fps[at]) <= radius]
        if len(some):
            found = band[some].tolist()
            edges += [(int(order[at]), int(order[x])) for x in found]
            queue += found
            alive = np.delete(alive, a + some)
    return edges


#: Rows of several batches that are looked at together.
TOGETHER = 1 << 16


def whole_keys(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]], together: int = TOGETHER) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by the first, key, cut only between keys: about together
    rows at a time, or a longer key."""
    pending: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        row = columns(batch)
        pending.append(row)
        held += len(row[0])
        if held < together or pending[0][0][0] == row[0][-1]:  # few, or all of one key: it goes on
            continue
        rows = [np.concatenate(x) for x in zip(*pending)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield [x[:cut] for x in rows]
        pending = [[x[cut:] for x in rows]]
        held = len(pending[0][0])
    if pending:
        yield [np.concatenate(x) for x in zip(*pending)]


def plain(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def parts_of_keys(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Like whole_keys, but if hot is given a key of over TOGETHER and hot rows isn't gathered: its rows come
    in several parts, each of that key alone, with True."""
    if hot is None:
        yield from ((rows, False) for rows in whole_keys(batches, plain))
        return
    pending: list[np.ndarray] | None = None
    over = None  # the key that comes in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = plain(batch)
        if over is not None:
            cut = int(np.searchsorted(rows[0], over, "right"))
            if cut:
                yield [x[:cut] for x in rows], True
            if cut == len(rows[0]):
                continue
            rows, over = [x[cut:] for x in rows], None
        pending = rows if pending is None else [np.concatenate(x) for x in zip(pending, rows)]
        if len(pending[0]) < TOGETHER:
            continue
        cut = int(np.searchsorted(pending[0], pending[0][-1]))
        if cut:
            yield [x[:cut] for x in pending], False
        pending = [x[cut:] for x in pending]
        if len(pending[0]) > hot:
            over = pending[0][-1]
            yield pending, True
            pending = None
    if pending is not None:
        yield pending, False


def spanning(dealt: DataFrame, radius: int, hot: int | None) -> DataFrame:
    """Edges u, v, in both senses, of the rows (key, node) that are sorted by key in their partitions;
    node: the fingerprint. If hot is given, rows of keys of more rows come as they are, without u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()[:, None]
        names = ["u", "v", "key", "node"]

        def put_off(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(node)], names)

        for (key, node), part in parts_of_keys(batches, hot):
            if part:
                yield put_off(key, node)
                continue
            wide = node.view(np.uint64)[:, None]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            count = ends - starts
            size = np.repeat(count, count)
            u, v = [], []
            for apart in range(1, SMALL):  # keys of few rows: neighbours at each distance at once
                at = np.flatnonzero((size[:-apart] <= SMALL) & (key[:-apart] == key[apart:]))
                at = at[distances(wide[at], wide[at + apart]) <= radius]
                u += node[at].tolist()
                v += node[at + apart].tolist()
            for a, b in zip(starts[count > SMALL].tolist(), ends[count > SMALL].tolist()):
                if hot is not None and b - a > hot:
                    yield put_off(key[a:b], node[a:b])
                    continue
                for x, y in forest(wide[a:b], radius, refs):
                    u.append(node[a + x])
                    v.append(node[a + y])
            none = pa.nulls(2 * len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([*u, *v], pa.int64()), pa.array([*v, *u], pa.int64()), none, none], names)

    return mapped(dealt, run, "u long, v long, key long, node long")


def dealt_by(rows: DataFrame, masks: list[int], *within: str) -> DataFrame:
    """node (a fingerprint) once for each mask, under the key of the bits that it leaves, and of the
    columns within."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(*within, F.lit(i), F.col("node").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    return rows.select(F.explode(keys).alias("key"), "node").repartition("key").sortWithinPartitions("key")


def finer_masks(radius: int) -> list[int]:
    """The 64 bits dealt in turn to one block more than linked fingerprints can differ in, so that they
    agree on one at least; each has its share of the bits that a key of whole blocks leaves open."""
    return [sum(1 << b for b in range(i, 64, radius + 1)) for i in range(radius + 1)]


def links(distinct: DataFrame, n: int, radius: int, hot: int = HOT) -> DataFrame:
    """Edges between distinct fingerprints that span every group linked within radius bits. Keys of over
    hot rows are cut into finer ones, which go to tasks of their own."""
    rows = distinct.select(F.col("fp").alias("node"))
    found = written(spanning(dealt_by(rows, block_keys(n, radius)[0]), radius, hot), "links")
    finer = spanning(dealt_by(found.where("u IS NULL").select("key", "node"), finer_masks(radius), "key"), radius, None)
    return found.where("u IS NOT NULL").select("u", "v").unionByName(finer.select("u", "v")).distinct()


def components(nodes: DataFrame, edges: DataFrame, order: str = "label") -> DataFrame:
    """nodes(fp, label) and edges(u, v; both senses) -> fp, label: the smallest label reachable.

    Labels of nodes are unlike each other. Each round takes the least label around a node, then
    the label that the owner of that label has got: paths shorten by half or more. Once no node
    has a lesser label around it, labels are alike along every edge, and it ends.
    """
    inner = nodes.join(edges.select(F.col("u").alias("fp")).distinct(), "fp", "left_semi")
    state = inner.select("fp", F.col("label").alias("own"), "label").checkpoint()
    while True:
        around = edges.join(state.select(F.col("fp").alias("v"), "label"), "v").groupBy(F.col("u").alias("fp")).agg(F.min("label").alias("near"))
        lower = state.join(around, "fp", "left").select("fp", "own", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label")).checkpoint()
        if lower.where("label < was").isEmpty():
            return lower.select("fp", "label")
        jump = lower.select(F.col("own").alias("label"), F.col("label").alias("far"))
        state = lower.join(jump, "label", "left").select("fp", "own", F.least("label", F.coalesce("far", "label")).alias("label")).checkpoint()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: its columns but text, fp, and component: the smallest key reachable."""
    prints = written(fingerprints(docs.drop("component"), text, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("label"))
    held = distinct.where(F.col("label").isNotNull()).checkpoint()
    edges = links(held, held.count(), radius).checkpoint()
    moved = components(held, edges)
    labels = written(held.withColumnRenamed("label", "own").join(moved, "fp", "left").select("fp", F.coalesce("label", "own").alias("component")), "labels")
    return prints.join(labels, "fp", "left").withColumn("component", F.coalesce("component", F.col(key)))


#: Texts of SHARED[0] common shingles in SHARED[1] of both are similar; so many words make a shingle.
SHARED, WIDE_WIDTH = (4, 5), 5

#: Documents whose shingles are counted, or one in so many if that is more, and the counts that are kept.
#: They set the order of shingles and so the cost; links don't depend on them.
SAMPLE, SAMPLE_PART, COMMON = 1 << 13, 64, 1 << 17

#: Bits of a set's parities. Sets of over half as many shingles fill them, and have further ones.
PARITIES = 2048


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = {w: digest(w, SEED) for w in set(words)}
    # A shingle's hash is a mix of its words' hashes in order.
    row = np.fromiter((each[w] for w in words), np.uint64, len(words))
    n = max(1, len(row) - WIDE_WIDTH + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(min(WIDE_WIDTH, len(row))):
        shingles = (shingles ^ row[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        shingles ^= shingles >> np.uint64(32)
    return np.unique(shingles)


def parities(shingles: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit, of a power of two. Two sets' parities differ
    in as many bits at most as they differ in shingles."""
    odd = np.zeros(bits, np.uint8)
    np.add.at(odd, (shingles % np.uint64(bits)).astype(np.int64), 1)
    return np.packbits(odd & 1).view(np.int64)


def further_parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of two to four bits a shingle, or none where PARITIES bits are so many."""
    bits = 1 << max(0, 2 * len(shingles) - 1).bit_length()
    return parities(shingles, bits) if bits > PARITIES else np.zeros(0, np.int64)


def with_sets(rows: DataFrame, text: str) -> DataFrame:
    """node and shingles of each row: the hash of its set of shingles, and the set."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batches(batch, text, 4 << 20):
                sets = [shingle_set(x) for x in chunks(part.column(text))]
                nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), listed(sets)], ["node", "shingles"])

    return mapped(rows.select(text), run, "node long, shingles array<long>")


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate(parts).view(np.int64)))


def common_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles that a sample of texts holds most often."""
    part = docs.where(F.pmod(F.xxhash64(text), F.lit(max(1, min(docs.count() // SAMPLE, SAMPLE_PART)))) == 0)
    counts = written(with_sets(part, text).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "shingle_counts")
    least, total = 2, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator():
        total += r.m
        if total > COMMON:
            least = r.n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    hashes, n_of = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n_of[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, so many that similar sets share one."""
    hashes, counts = common
    own, n = np.sort(shingles.view(np.int64)), len(shingles)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        own = own[np.argsort(np.where(hashes[at] == own, counts[at], 0), kind="stable")]
    return own[: n - (n * SHARED[0] + SHARED[1] - 1) // SHARED[1] + 1]


def prefixes(docs: DataFrame, key: str, text: str, common: tuple[np.ndarray, np.ndarray], width: int | None = None) -> DataFrame:
    """key, text_hash, node, size, odd and more: the set's parities and further parities, and first: its
    prefix, all empty for a set that the task has met; and fp, the fingerprint, if width is given."""
    import xxhash

    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in cut_batches(batch, text):
                nodes, sizes, odd, more, first, fps = [], [], [], [], [], []
                for of, x in zip(part.column(key).is_valid().to_pylist(), chunks(part.column(text))):
                    own = shingle_set(x)
                    node = xxhash.xxh3_64_intdigest(own.tobytes())
                    nodes.append(node)
                    sizes.append(len(own))
                    new = of and node not in seen
                    if new:
                        seen.add(node)
                    odd.append(parities(own) if new else own[:0])
                    more.append(further_parities(own) if new else own[:0])
                    first.append(prefix(own, common) if new else own[:0])
                    if width is not None:
                        fps.append(fingerprint(x, width))
                prints = [] if width is None else [pa.array(fps, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("text_hash"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *(listed([x.view(np.int64) for x in lists]) for lists in (odd, more, first)), *prints], out.names)

    out = T.StructType([kind, *T.StructType.fromDDL("text_hash long, node long, size int, odd array<long>, more array<long>, first array<long>" + ("" if width is None else ", fp long"))])
    return mapped(docs.select(key, text, F.xxhash64(text).alias("text_hash")), run, out)


def dealt_prefixes(prints: DataFrame) -> DataFrame:
    """key, node, size, place: once for each shingle of the prefixes."""
    return prints.select(F.posexplode("first").alias("place", "key"), "node", "size").select("key", "node", "size", "place")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "size", "node")


def may_be_similar(size: np.ndarray, place: np.ndarray, other_size: np.ndarray, other_place: np.ndarray) -> np.ndarray:
    """Whether two sets can be similar of which a shingle at these places is the first in common."""
    most = np.minimum(size - place, other_size - other_place).astype(np.int64)
    return sum(SHARED) * most >= SHARED[0] * (size.astype(np.int64) + other_size)


def near_pairs(dealt: DataFrame) -> DataFrame:
    """u, v: candidates within a key, all of a key of SMALL rows at most, the next AROUND by size in a
    larger one. Rows of larger keys come as they are too, without u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_keys(batches, plain):
            key, node, _, _ = columns
            first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # copies in other tasks
            key, node, size, place = (x[first] for x in columns)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[starts, len(key)])
            large = np.repeat(count > SMALL, count)
            us, vs = [], []
            for apart in range(1, SMALL):
                at = np.flatnonzero((key[:-apart] == key[apart:]) & ((apart <= AROUND) | ~large[:-apart]))
                at = at[may_be_similar(size[at], place[at], size[at + apart], place[at + apart])]
                us.append(node[at])
                vs.append(node[at + apart])
            u, v = np.concatenate(us), np.concatenate(vs)
            none = pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), *none], ["u", "v", "key", "node", "size", "place"])
            if large.any():
                none = pa.nulls(int(large.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x[large]) for x in (key, node, size, place))], ["u", "v", "key", "node", "size", "place"])

    return mapped(dealt, run, "u long, v long, key long, node long, size int, place int")


def far_pairs(dealt: DataFrame, spanning: bool) -> DataFrame:
    """u, v: candidates within a key, of rows (key, node, size, place, label, odd) of unlike labels, that
    parities don't rule out: all of them, or, if spanning, so many that each key's are joined by them."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        odd = batch.column("odd").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        return [*(batch.column(x).to_numpy() for x in ("key", "node", "size", "place", "label")), odd]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size, place, label, odd in whole_keys(batches, columns, TOGETHER >> 3):
            size, label = size.astype(np.int64), label.copy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            us, vs, held = [], [], 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                ends = a + np.searchsorted(size[a:b], size[a:b] * SHARED[1] // SHARED[0], "right")
                for i, end in zip(range(a, b), ends.tolist()):
                    at = i + 1 + np.flatnonzero(label[i + 1 : end] != label[i])
                    at = at[may_be_similar(size[i : i + 1], place[i : i + 1], size[at], place[at])]
                    if not len(at):
                        continue
                    at = at[distances(odd[at], odd[i]).astype(np.int64) * sum(SHARED) <= (size[at] + size[i]) * (SHARED[1] - SHARED[0])]
                    if spanning and len(at):
                        met, first = np.unique(label[at], return_index=True)
                        at = at[first]
                        own = label[a:b]
                        own[np.isin(own, met)] = label[i]
                    us.append(np.minimum(node[i], node[at]))
                    vs.append(np.maximum(node[i], node[at]))
                    held += len(at)
                    if held > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                        us, vs, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return mapped(dealt, run, "u long, v long").distinct()


def with_both(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """pairs(u, v) with the rows of own, by node, as the structs a and b."""
    return pairs.join(own.select(F.col("node").alias("u"), F.struct(*own.columns).alias("a")), "u").join(own.select(F.col("node").alias("v"), F.struct(*own.columns).alias("b")), "v")


def differing(a: Column, b: Column) -> Column:
    """Differing bits of two sets' parities. Those of more bits are folded once: similar sets' sizes are
    so near that one has twice the other's bits at most; null beyond that."""
    bits = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > bits, F.zip_with(F.slice(x, F.lit(1), bits), F.slice(x, bits + 1, bits), lambda y, z: y.bitwiseXOR(z))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def ruled_out() -> Column:
    """Whether the parities of the structs a and b (size, odd) differ in more bits than similar sets'."""
    return F.coalesce(differing(F.col("a.odd"), F.col("b.odd")) * sum(SHARED) > (F.col("a.size") + F.col("b.size")) * (SHARED[1] - SHARED[0]), F.lit(True))


def not_ruled_out(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs whose parities, in sizes(node, size, odd), leave it open that they are similar."""
    return with_both(pairs, sizes).where(~ruled_out()).select("u", "v")


def still_open(pairs: DataFrame, long_sets: DataFrame) -> DataFrame:
    """The pairs but those of two long sets whose further parities, in long_sets(node, size, odd), rule
    them out."""
    gone = with_both(pairs, long_sets).where(ruled_out()).select("u", "v")
    return pairs.join(gone, ["u", "v"], "left_anti")


def similar(pairs: DataFrame, held: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Edges u, v, in both senses, of the pairs (a written table) whose sets are similar. The sets of
    texts that are in a pair are built again, from the texts."""
    met = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(held, "node"), "met")
    texts = docs.select(key, text).join(met.select(F.col("label").alias(key)), key, "left_semi")
    own = written(with_sets(texts, text).join(met, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    shared = F.size(F.array_intersect("a.shingles", "b.shingles"))
    found = with_both(pairs, own).where(shared * sum(SHARED) >= (F.size("a.shingles") + F.size("b.shingles")) * SHARED[0])
    return written(found.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*"), "edges")


def numbered(labels: DataFrame) -> DataFrame:
    """node, label (a key, and the node that it is of, as nodes may share a key) and number, that node."""
    return written(labels.withColumn("number", F.col("label.node")), "labels")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels once further edges between nodes join components: these are nodes of a smaller graph."""
    one, other = labels.select(F.col("node").alias("u"), F.col("number").alias("a")), labels.select(F.col("node").alias("v"), F.col("number").alias("b"))
    between = written(edges.join(one, "u").join(other, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "between")
    if between.isEmpty():
        return labels
    moved = components(labels.select(F.col("number").alias("fp"), "label").distinct(), between)
    return numbered(labels.join(moved.withColumnsRenamed({"fp": "number", "label": "moved"}), "number", "left").select("node", F.coalesce("moved", "label").alias("label")))


def unlike(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that aren't in one component yet."""
    one, other = labels.select(F.col("node").alias("u"), F.col("number").alias("a")), labels.select(F.col("node").alias("v"), F.col("number").alias("b"))
    return pairs.join(one, "u").join(other, "v").where("a <> b").select("u", "v")


def linked_sets(prints: DataFrame, key: str, radius: int) -> DataFrame:
    """Edges u, v, in both senses, between nodes (sets of shingles) whose texts' fingerprints are within
    radius bits: those of one fingerprint are joined by its least node, which stands for it in links."""
    own = written(prints.where(F.col(key).isNotNull()).select("fp", "node").distinct(), "set_prints")
    least = written(own.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    found = links(least, least.count(), radius)
    one, other = least.select(F.col("fp").alias("u"), F.col("least").alias("a")), least.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    between = found.join(one, "u").join(other, "v").select("a", "b")
    alike = own.join(least, "fp").select(F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("least").alias("b")), F.struct(F.col("least").alias("a"), F.col("node").alias("b")))).alias("e")).select("e.*")
    return written(between.unionByName(alike).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "print_edges")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int | None = None) -> DataFrame:
    """One row a document: key, text_hash (xxhash64 of the text, which tells texts of one key apart) and
    component: the smallest key among texts that links of a similarity of 0.8 of five-word shingles
    reach. If radius is given, fingerprints (of shingles of width words) within so many bits are links too,
    and come first: only texts that they leave apart are held against each other."""
    prints = written(prefixes(docs, key, text, common_shingles(docs, text), None if radius is None else width), "prefixes")
    held = written(prints.groupBy("node").agg(F.min(key).alias("label")).where(F.col("label").isNotNull()), "nodes")
    labels = numbered(held.select("node", F.struct("label", "node").alias("label")))
    if radius is not None:
        labels = merged(labels, linked_sets(prints, key, radius))
    found = written(near_pairs(by_key(dealt_prefixes(prints))), "candidates")
    sizes = written(prints.where(F.size("odd") > 0).groupBy("node").agg(F.first("size").alias("size"), F.first("odd").alias("odd")), "sizes")
    long_sets = written(prints.where(F.size("more") > 0).groupBy("node").agg(F.first("size").alias("size"), F.first("more").alias("odd")), "long_sets")
    open_pairs = written(not_ruled_out(found.where("u IS NOT NULL").select("u", "v").distinct(), sizes), "open")
    near = written(unlike(still_open(open_pairs, long_sets), labels), "near")
    # At first two pairs a text at most; then pairs that span what is still apart, if all of them hold;
    # then all that are apart even so, which are few.
    some = near.groupBy("u").agg(F.min("v").alias("v")).unionByName(near.groupBy("v").agg(F.min("u").alias("u")))
    labels = merged(labels, similar(written(some.distinct(), "first"), held, docs, key, text))
    large = written(found.where("u IS NULL").select("key", "node", "size", "place"), "large")
    for spanning in (True, False):
        labelled = written(large.join(labels.select("node", F.col("number").alias("label")), "node"), "labelled")
        apart = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
        rows = labelled.join(apart, "key", "left_semi").join(sizes.select("node", "odd"), "node").select("key", "node", "size", "place", "label", "odd")
        far = written(far_pairs(by_key(rows), spanning), "far")
        further = written(unlike(near, labels).unionByName(still_open(far, long_sets)).distinct(), "further")
        if further.isEmpty():
            break
        labels = merged(labels, similar(further, held, docs, key, text))
    labels = labels.select("node", F.col("label.label").alias("component"))
    return prints.select(key, "text_hash", "node").join(labels, "node", "left").select(key, "text_hash", F.coalesce("component", F.col(key)).alias("component"))
