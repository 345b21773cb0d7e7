"""Suffix-array dedup of exact substrings by a common-prefix-aware distributed merge sort.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller key.

Which suffixes. Every LENGTH-byte string has an anchor: the place of its least KMER-byte hash, the
leftmost of equals. Equal strings have their anchors at the same offset, so suffixes need to be
sorted at anchors only, each for the strings that it anchors. An anchor whose first KMER bytes stand
in one document alone can't match; groups of documents exchange sorted hashes of those bytes and get
a bit for each back (a hash too many is no error, for contents are compared later).

Sorting. Each group of documents sorts the suffixes at its remaining anchors, merges equal ones
(keeping the smallest key, so a passage that many documents share is sent once a group), and sends
them front-coded: the length of the prefix shared with the suffix before, and the rest. A task takes
a range of suffixes, one run a group, and combines the runs with a loser tree: heads carry the
length they share with the last winner, so a comparison looks at characters beyond it only, and the
tree gives the common prefixes of the merged order. Ranges come from a bounded sample of documents.

Deciding. In the merged order, strings of LENGTH bytes around an anchor are equal if the suffixes
share LENGTH - offset bytes and the bytes before share offset, so ranks of both give the smallest
key of every string. What goes back to a group of documents is a mask of strings for each anchor.

Nulls are empty texts; texts shorter than LENGTH lose nothing. Keys are whole numbers; a null key is
larger than any other. Rows with equal keys, repeated rows among them, don't match each other: neither
is smaller. Texts of any length are taken whole, in pieces that overlap. An empty table gives an empty
result. The key and the text are read by name and the other columns, whatever their names, are left
out; the result has its own columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mapped

LENGTH, KMER = 50, 24
OFFSETS = LENGTH - KMER + 1  # places an anchor can have in its string

#: Least and most bytes of text in a group of documents, and for each task of a merge, about.
#: Between them groups grow with the square root of the corpus: each sends a row to each bucket.
GROUP_BYTES, MOST_GROUP_BYTES, ROW_BYTES = 12 << 20, 128 << 20, 4096

#: Places that are looked at together.
SLICE = 1 << 20

#: Documents, and anchors of each, that the ranges are fitted on.
SAMPLE_DOCS, SAMPLE_ANCHORS = 500, 40

NO_KEY = np.iinfo(np.int64).max


def kmer_hashes(text: np.ndarray) -> np.ndarray:
    """Of the KMER bytes from each place that has so many."""
    base = np.uint64(0x9E3779B97F4A7C15)

    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(base), n, 1 << 64))

    one = text.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * base + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    both = eight[:-8] * power(8) + eight[8:]
    found = both[:-8] * power(8) + eight[16:]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, the first and last start of the strings that each anchors, and the hashes
    of their KMER bytes. text: documents one after another; ends: where each ends."""
    found: list[tuple[np.ndarray, ...]] = []
    n = len(text)
    valid = np.ones(n, bool)
    for back in range(1, LENGTH):
        at = ends - back
        valid[at[at >= 0]] = False
    for a in range(0, n - LENGTH + 1, SLICE):
        part = text[a : a + SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        hashes = kmer_hashes(part)
        low = ((hashes >> np.uint64(34)) << np.uint64(33) | np.arange(len(hashes), dtype=np.uint64)).view(np.int64)
        width = 1
        while 2 * width <= OFFSETS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < OFFSETS:
            low = np.minimum(low[: len(low) - (OFFSETS - width)], low[OFFSETS - width :])
        starts = np.flatnonzero(valid[a : a + len(low)])
        at = low[starts] & ((1 << 33) - 1)
        # A new anchor, or a gap between starts, begins another record.
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[first[1:] - 1, len(at) - 1] if len(at) else first
        found.append((at[first] + a, starts[first] + a, starts[last] + a, hashes[at[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


class Group:
    """The documents of a group in order of key, then text: their bytes, ends and keys."""

    def __init__(self, table: pa.Table, key: str, text: str):
        table = table.combine_chunks()
        texts = [x for column in table.column(text).chunks for x in chunks(column)]
        keys = table.column(key)
        self.null = np.asarray(keys.is_null())
        held = np.where(self.null, NO_KEY, np.asarray(keys.fill_null(0).cast(pa.int64())))
        order = sorted(range(len(texts)), key=held.tolist().__getitem__)
        if len(np.unique(held)) < len(held):
            order.sort(key=lambda i: (held[i], texts[i]))
        self.order = order
        self.texts = [texts[i] for i in order]
        self.keys = held[order]
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def keyed(self, at: np.ndarray) -> np.ndarray:
        return self.keys[np.searchsorted(self.ends, at, side="right")]


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """bucket << 32 | 32 bits of the hash, in one number."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(n)
    return bucket << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


KEYS = "t int, bucket int, keys binary, several binary"


def send_hashes(group: Group, t: int, n_buckets: int) -> pa.Table:
    """The distinct hashes of a group by bucket, each with a bit: in several documents here."""
    at, _, _, hashes = anchors(group.bytes, group.ends)
    held = buckets_of(hashes, n_buckets)
    order = np.argsort(held, kind="stable")
    held, keys = held[order], group.keyed(at)[order]
    new = np.r_[True, held[1:] != held[:-1]] if len(held) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    several = np.maximum.reduceat(keys, first) != np.minimum.reduceat(keys, first) if len(first) else np.zeros(0, bool)
    held = held[first]
    cut = np.searchsorted(held, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))
    low = held.astype(np.uint32)
    rows = [(t, b, low[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["t", "bucket", "keys", "several"])


MASKS = "t int, bucket int, mask binary"


def shared_hashes(table: pa.Table) -> pa.Table:
    """A bit for each hash sent to a bucket: another group, or several documents, have it too."""
    sent = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several").to_pylist(), sent)]
    every = np.sort(np.concatenate([*sent, *(k[s] for k, s in zip(sent, several))]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    masks = [np.packbits(twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k).tobytes() if len(twice) and len(k) else np.packbits(np.zeros(len(k), bool)).tobytes() for k in sent]
    return pa.table([table.column("t"), table.column("bucket"), pa.array(masks, pa.binary())], ["t", "bucket", "mask"])


def common(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each row of a matrix shares with the row before."""
    n = len(a)
    found = np.zeros(n, np.int64)
    if n > 1:
        differ = a[1:] != a[:-1]
        found[1:] = np.where(differ.any(1), differ.argmax(1), a.shape[1])
        found[1:] = np.minimum(found[1:], np.minimum(lengths[1:], lengths[:-1]))
    return found


def suffixes_at(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row for each place: its LENGTH bytes, with zeros from length on."""
    held = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(LENGTH, np.uint8)], LENGTH)[at]
    held[np.arange(LENGTH, dtype=np.uint8) >= length.astype(np.uint8)[:, None]] = 0
    return held


def before_places(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row for each place: the OFFSETS - 1 bytes before it, the nearest first, with zeros from length on."""
    held = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(OFFSETS - 1, np.uint8), data], OFFSETS - 1)[at][:, ::-1].copy()
    held[np.arange(OFFSETS - 1, dtype=np.uint8) >= length.astype(np.uint8)[:, None]] = 0
    return held


RUNS = "t int, range int, shared binary, length binary, before_length binary, rest binary, before binary, keys binary, n_first binary, n_all binary, places binary"


def send_runs(group: Group, masks: pa.Table, t: int, n_buckets: int, splits: np.ndarray) -> pa.Table:
    """The sorted, front-coded suffixes at shared anchors by range."""
    at, low, high, hashes = anchors(group.bytes, group.ends)
    held = buckets_of(hashes, n_buckets)
    distinct, where = np.unique(held, return_inverse=True)
    cut = np.searchsorted(distinct, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))
    alive = np.zeros(len(distinct), bool)
    for b, mask in zip(masks.column("bucket").to_pylist(), masks.column("mask").to_pylist()):
        alive[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
    some = np.flatnonzero(alive[where]) if len(where) else np.zeros(0, np.int64)
    at, low, high = at[some], low[some], high[some]
    length, before_length = (high + LENGTH - at), (at - low)
    suffix, before = suffixes_at(group.bytes, at, length), before_places(group.bytes, at, before_length)
    whole = np.concatenate([suffix, length[:, None].astype(np.uint8), before, before_length[:, None].astype(np.uint8)], axis=1)
    del suffix, before
    keys = group.keyed(at)
    # Places are in order of the key already, so a stable sort keeps the smallest key first.
    order = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable") if len(at) else np.zeros(0, np.int64)
    whole, keys, at = whole[order], keys[order], at[order]
    first = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]).any(1)]) if len(at) else np.zeros(0, np.int64)
    n_all = np.diff(np.r_[first, len(at)])
    own = np.repeat(keys[first], n_all) == keys
    n_first = np.add.reduceat(own.astype(np.int64), first) if len(first) else n_all
    whole, keys = whole[first], keys[first]
    suffix, length = whole[:, :LENGTH], whole[:, LENGTH].astype(np.int64)
    before, before_length = whole[:, LENGTH + 1 : -1], whole[:, -1].astype(np.int64)
    ranges = np.searchsorted(splits, np.ascontiguousarray(suffix[:, :16]).view("S16").ravel(), side="right") if len(splits) and len(first) else np.zeros(len(first), np.int64)
    ends = np.cumsum(n_all)
    rows = []
    for a, b in zip(*((c := np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])), np.r_[c[1:], len(ranges)])) if len(ranges) else ():
        part = slice(a, b)
        shared = common(suffix[part], length[part])
        rest = (np.arange(LENGTH) >= shared[:, None]) & (np.arange(LENGTH) < length[part][:, None])
        left = np.arange(OFFSETS - 1) < before_length[part][:, None]
        small = lambda x: x.astype(np.uint8).tobytes()
        rows.append((t, int(ranges[a]), small(shared), small(length[part]), small(before_length[part]), suffix[part][rest].tobytes(), before[part][left].tobytes(), keys[part].tobytes(), n_first[part].astype(np.uint32).tobytes(), n_all[part].astype(np.uint32).tobytes(), at[ends[a] - n_all[a] : ends[b - 1]].astype(np.uint32).tobytes()))
    names = [x.split()[0] for x in RUNS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 11, [pa.int32(), pa.int32(), *[pa.binary()] * 9])], names)


def decoded(shared: bytes, length: bytes, rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    found, last, at = [], b"", 0
    for s, n in zip(shared, length):
        end = at + n - s
        last = last[:s] + rest[at:end]
        at = end
        found.append(last)
    return found


def merge(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[int], list[int], list[int]]:
    """Run, row and prefix shared with the one before, for each suffix in merged order.

    runs: sorted suffixes, and the length each shares with the one before in its run. A loser tree
    holds the heads that lost, each with the length that it shares with the winner that beat it.
    Of two heads, the one that shares more with the last winner is smaller; only heads that share
    the same length are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    texts = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1] for r in runs] + [b""] * (k - len(runs))
    sizes = [len(x) for x in texts]
    row = [0] * k
    tree = [0] * k  # the losing run at each inner node
    share = [0] * k  # of each head, with the last winner that passed it; -1: no head
    head: list[bytes | None] = [x[0] if x else None for x in texts]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length is then with this winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        h = share[a]
        n = min(len(x), len(y))
        while h < n and x[h] == y[h]:
            h += 1
        if h == n:
            less = len(x) < len(y) or len(x) == len(y) and a < b
        else:
            less = x[h] < y[h]
        if less:
            share[b] = h
            return a, b
        share[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    out_run, out_row, out_share = [], [], []
    best = build(1)
    while head[best] is not None:
        out_run.append(best)
        out_row.append(row[best])
        out_share.append(share[best])
        row[best] += 1
        at = row[best]
        if at < sizes[best]:
            head[best] = texts[best][at]
            share[best] = shares[best][at]
        else:
            head[best] = None
        node = (best + k) >> 1
        while node:
            other = tree[node]
            x, y = head[best], head[other]
            if x is None:
                if y is not None:
                    tree[node], best = best, other
            elif y is not None:
                a, b = share[best], share[other]
                if a == b:
                    best, tree[node] = play(best, other)
                elif a < b:
                    tree[node], best = best, other
            node >>= 1
    return out_run, out_row, out_share


FOUND = "t int, places binary, masks binary"


def repeated(table: pa.Table) -> pa.Table:
    """For a range of suffixes: the anchors with strings that start in a document of a smaller key,
    and a bit for each such string's offset."""
    held = {name: table.column(name).to_pylist() for name in table.schema.names}
    runs = [(decoded(s, n, r), s) for s, n, r in zip(held["shared"], held["length"], held["rest"])]
    run, row, shared = (np.array(x, dtype=np.int64) for x in merge(runs))
    first = np.cumsum([0, *(len(r[0]) for r in runs)])
    at = first[run] + row  # in the order of the runs

    def joined(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in held[name]])

    length, before_length = joined("length", np.uint8)[at].astype(np.int64), joined("before_length", np.uint8).astype(np.int64)
    flat = np.frombuffer(b"".join(held["before"]), np.uint8)
    before = np.zeros((len(at), OFFSETS - 1), np.uint8)
    before[np.arange(OFFSETS - 1) < before_length[:, None]] = flat
    before, before_length = before[at], before_length[at]
    keys = joined("keys", np.int64)[at]
    n = len(at)
    order = np.argsort(np.ascontiguousarray(np.concatenate([before, before_length[:, None].astype(np.uint8)], axis=1)).view(f"S{OFFSETS}").ravel(), kind="stable")
    left_shared = common(before[order], before_length[order])
    masks = np.zeros(n, np.uint32)
    for offset in range(OFFSETS):
        some = np.flatnonzero((offset >= LENGTH - length) & (offset <= before_length))
        if len(some) < 2:
            continue
        right = np.cumsum(shared < LENGTH - offset)
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(left_shared < offset) if offset else 0
        string = right[some] * (n + 1) + left[some]
        by = np.argsort(string, kind="stable")
        string = string[by]
        new = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
        least = np.repeat(np.minimum.reduceat(keys[some[by]], new), np.diff(np.r_[new, len(by)]))
        hit = some[by][least < keys[some[by]]]
        masks[hit] |= np.uint32(1 << offset)
    # All strings of further copies within a group have a smaller key there.
    every = ((np.int64(1) << (before_length + 1)) - (np.int64(1) << (LENGTH - length))).astype(np.uint32)
    own, whole = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    own[at], whole[at] = masks, every
    n_first, n_all = joined("n_first", np.uint32).astype(np.int64), joined("n_all", np.uint32).astype(np.int64)
    place = np.arange(n_all.sum()) - np.repeat(np.cumsum(n_all) - n_all, n_all)
    mask = np.where(place < np.repeat(n_first, n_all), np.repeat(own, n_all), np.repeat(whole, n_all))
    rows, a = [], 0
    for t, places in zip(held["t"], held["places"]):
        places = np.frombuffer(places, np.uint32)
        here = mask[a : a + len(places)]
        a += len(places)
        some = here > 0
        if some.any():
            rows.append((t, places[some].tobytes(), here[some].tobytes()))
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["t", "places", "masks"])


def cut_out(group: Group, found: pa.Table, kind: pa.DataType, key: str) -> pa.Table:
    """What is left of each document of a group."""
    n = len(group.bytes)
    edge = np.zeros(n + 1, np.int32)
    for places, masks in zip(found.column("places").to_pylist(), found.column("masks").to_pylist()):
        places, masks = np.frombuffer(places, np.uint32).astype(np.int64), np.frombuffer(masks, np.uint32)
        for offset in range(OFFSETS):
            start = places[(masks >> np.uint32(offset)) & np.uint32(1) > 0] - offset
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
    gone = np.cumsum(edge[:n]) > 0
    ids, spans, kept = [], [], []
    begin = 0
    for i, end in enumerate(group.ends.tolist()):
        own = gone[begin:end]
        at = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2)
        spans.append(at.tolist())
        kept.append(group.bytes[begin:end][~own].tobytes() if len(at) else group.texts[i])
        ids.append(None if group.null[group.order[i]] else int(group.keys[i]))
        begin = end
    return pa.table([pa.array(ids, pa.int64()).cast(kind), pa.array([len(x) for x in group.texts], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])


def splitters(docs: DataFrame, n_docs: int, ranges: int, key: str, text: str) -> np.ndarray:
    """Starts of the ranges after the first, from the anchors of at most about SAMPLE_DOCS
    documents; whatever they are, equal suffixes fall into one range."""
    sample = docs.where(F.pmod(F.xxhash64(key), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in chunks(batch.column(text)):
                at = anchors(np.frombuffer(x, np.uint8), np.array([len(x)]))[0]
                found += [x[a : a + 16] for a in at[:: max(1, -(-len(at) // SAMPLE_ANCHORS))].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["start"])

    held = np.sort(np.array([bytes(r[0]) for r in mapped(sample, run, "start binary").collect()], dtype="S16"))
    return np.unique(held[np.arange(1, ranges) * len(held) // ranges]) if len(held) else held


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_bytes, spans ([first, last + 1) of removed bytes), kept."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    held = min(MOST_GROUP_BYTES, max(GROUP_BYTES, int(((n_bytes or 0) * ROW_BYTES) ** 0.5)))
    # A small corpus is dealt to as many tasks as there are, down to a MB each.
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) >> 20)
    groups = max(1, few, -(-(n_bytes or 0) // held))
    splits = splitters(docs, n_docs, groups, key, text)
    dealt = docs.withColumn("t", F.pmod(F.xxhash64(key, text), F.lit(groups)).cast("int"))
    kind = T.StructType([docs.schema[key]])

    def first(name: tuple, table: pa.Table) -> pa.Table:
        return send_hashes(Group(table, key, text), name[0].as_py(), groups)

    def second(name: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        return send_runs(Group(table, key, text), masks, name[0].as_py(), groups, splits)

    def last(name: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        return cut_out(Group(table, key, text), found, table.schema.field(key).type, key)

    out = T.StructType([*kind.fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])
    masks = dealt.groupBy("t").applyInArrow(first, KEYS).groupBy("bucket").applyInArrow(shared_hashes, MASKS)
    runs = dealt.groupBy("t").cogroup(masks.groupBy("t")).applyInArrow(second, RUNS)
    found = runs.groupBy("range").applyInArrow(repeated, FOUND)
    return dealt.groupBy("t").cogroup(found.groupBy("t")).applyInArrow(last, out)
