"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters and digits (ASCII, lower-cased) and of any non-ASCII characters. A phrase
is a window of ``width`` consecutive words of a benchmark item, or the whole of a shorter item.

Each task cuts its documents into shards of about SHARD words that can matter: words that no phrase
has are separators, and a run between separators that is shorter than the shortest phrase can't
hold one. Of each shard it builds the suffix array, the Burrows-Wheeler transform, a wavelet matrix
that ranks any word at any place, and a sample of suffix positions (every SAMPLE-th place, and all
starts of runs, so that no step crosses a separator). All phrases are searched backwards at once;
the places found are located by stepping to a sampled suffix. Places become hit words, and hit
words are merged into removal spans.

Phrases are the broadcast side. Windows are cut by Spark and come to the driver in blocks of BLOCK at
most, so the size of a broadcast is bounded whatever the benchmark's and its items' sizes. Each block
is a narrow pass over the documents, and hits add up in a column; with several blocks the rows are
written between passes, so that a task never holds more than one index. No document is shuffled.

Null and empty texts have no words; null and empty items have no phrases. Items with a null id hit
words and are reported as ``null``, as an item of that name would be. Repeated items are one item, and
all items that share a window are reported; repeated documents are judged one by one. Very long texts
are a shard of their own, whole. Empty tables give empty results. Columns of other names pass through;
those of the names in FOUND are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut_batches, lower_ascii, mapped, written
from .suffixes import suffix_array

WIDTH = 10
SHARD, SAMPLE, BLOCK = 1 << 20, 16, 1 << 18

#: Bytes of documents that wait for a shard's index, and places that are located together.
WAITING, LOCATED = 32 << 20, 1 << 16

#: Every byte that no word has becomes a space; A-Z become a-z.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Phrases:
    """Windows with the items that have them. Word numbers start at 1; 0 is any other word."""

    def __init__(self, windows: list[tuple[list[bytes], list[str]]]):
        self.number: dict[bytes, int] = {}
        self.names = sorted({name for _, held in windows for name in held})
        known = {name: i for i, name in enumerate(self.names)}
        own = [([self.number.setdefault(w, len(self.number) + 1) for w in words], sorted(known[x] for x in held)) for words, held in windows]
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in sorted({len(words) for words, _ in own}):
            some = [x for x in own if len(x[0]) == length]
            self.by_length[length] = (np.array([x[0] for x in some], dtype=np.int64), [x[1] for x in some])
        self.shortest = min(self.by_length, default=0)


def windows(benchmark: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """window (its words between spaces) and items, the sorted names of those that have it."""
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = named.select("item", F.explode(F.transform(starts, lambda a: F.array_join(F.slice("words", a, F.lit(width)), " "))).alias("window"))
    return cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class FMIndex:
    """Of a text of numbers from 0 (separator) to top, with sampled suffix positions."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        self.n = n
        # A separator sorts by its place, before all words: no comparison runs across one.
        symbols = np.where(text == 0, np.arange(n), text + n)
        order, _ = suffix_array(symbols, keep_ranks=False)
        before = np.where(order > 0, text[order - 1], 0)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 2))]
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(top + 1).bit_length())
        row = before.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = (row >> k) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, n - int(ones[-1])))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.before = before
        starts = np.r_[True, text[:-1] == 0]
        sampled = (order % SAMPLE == 0) | starts[order] | (text[order] == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row `at` of the transform."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            bit = ((symbol >> k) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return high - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their ranges of rows."""
        alive = np.arange(len(windows))
        last = windows[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for column in range(windows.shape[1] - 2, -1, -1):
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
            symbol = windows[alive, column]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        some = high > low
        return alive[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of the suffix in each row."""
        rows = rows.copy()
        places, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_at = np.arange(len(rows))
        while len(open_at):
            done = self.sampled[rows[open_at]]
            ready = open_at[done]
            places[ready] = self.samples[self.sample_rank[rows[ready]]] + steps[ready]
            open_at = open_at[~done]
            symbol = self.before[rows[open_at]]
            rows[open_at] = self.first[symbol] + self.rank(symbol, rows[open_at])
            steps[open_at] += 1
        return places


class Shard:
    """Runs of phrase words, each at its place in the words of all waiting documents."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[np.ndarray] = []  # numbers, each run followed by a separator
        self.starts: list[int] = []
        self.size = 0

    def add(self, at: int, numbers: np.ndarray) -> None:
        """The words of a document, of which the first is at this place."""
        edge = np.flatnonzero(np.diff(np.r_[False, numbers > 0, False]))
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= self.phrases.shortest].tolist():
            self.parts.append(np.r_[numbers[a:b], 0])
            self.starts.append(at + a)
            self.size += b - a + 1

    def hits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of a window, places, windows): parallel arrays of occurrences."""
        if not self.parts:
            return
        text = np.concatenate(self.parts)
        begin = np.r_[0, np.cumsum([len(p) for p in self.parts])[:-1]]
        starts = np.array(self.starts, np.int64)
        index = FMIndex(text, len(self.phrases.number))
        for length, (numbers, _) in self.phrases.by_length.items():
            found, low, high = index.search(numbers)
            part = np.cumsum(high - low) // LOCATED
            for k in np.unique(part).tolist():
                some = part == k
                counts = high[some] - low[some]
                rows = np.repeat(low[some] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                places = index.locate(rows)
                run = np.searchsorted(begin, places, side="right") - 1
                yield length, starts[run] + places - begin[run], np.repeat(found[some], counts)


def cleaned(text: bytes, cut: list[list[int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, last = [], 0
    for a, b in cut:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


class Waiting:
    """Documents whose hits aren't known yet, and the shard of their words."""

    def __init__(self, phrases: Phrases, text: str):
        self.phrases, self.text, self.shard = phrases, text, Shard(phrases)
        self.parts: list[pa.RecordBatch] = []
        self.counts: list[int] = []  # of words, by document
        self.words = self.bytes = 0

    def add(self, part: pa.RecordBatch) -> None:
        own, number = self.phrases, self.phrases.number
        for x in chunks(part.column(self.text)):
            words = words_of(x)
            if own.shortest and len(words) >= own.shortest:
                self.shard.add(self.words, np.fromiter((number.get(w, 0) for w in words), np.int64, len(words)))
            self.counts.append(len(words))
            self.words += len(words)
        self.parts.append(part)
        self.bytes += part.nbytes

    def found(self) -> tuple[dict[int, list[list[int]]], dict[int, set[str]]]:
        """By document: spans of hit words, and items; with those of earlier passes."""
        first = np.r_[0, np.cumsum(np.array(self.counts, np.int64))]
        edge = np.zeros(self.words + 1, np.int32)
        items: dict[int, set[str]] = {}
        for length, places, window in self.shard.hits():
            np.add.at(edge, places, 1)
            np.add.at(edge, places + length, -1)
            _, held = self.phrases.by_length[length]
            rows = np.searchsorted(first, places, side="right") - 1
            for row, w in np.unique(np.stack([rows, window]), axis=1).T.tolist():
                items.setdefault(row, set()).update(self.phrases.names[i] for i in held[w])
        row = 0
        for part in self.parts:
            if "spans" in part.schema.names:
                for k, (before, names) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                    for a, b in before:
                        edge[first[row + k] + a] += 1
                        edge[first[row + k] + b] -= 1
                    if names:
                        items.setdefault(row + k, set()).update(names)
            row += part.num_rows
        hit = np.cumsum(edge[:-1]) > 0
        spans = {}
        for row in items:
            a = first[row]
            spans[row] = np.flatnonzero(np.diff(np.r_[False, hit[a : first[row + 1]], False])).reshape(-1, 2).tolist()
        return spans, items


def search(docs: DataFrame, phrases: Phrases, text: str, cut: bool = False) -> DataFrame:
    """One pass: adds to n_words, spans (of hit words) and items what a block of phrases hits; or, if
    cut, takes all spans out of the text and these columns away."""
    mine = {x.name for x in FOUND}
    rest = [f for f in docs.schema.fields if f.name not in mine]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Phrases = shared.value

        def done(waiting: Waiting) -> Iterator[pa.RecordBatch]:
            spans, items = waiting.found()
            first = 0
            for part in waiting.parts:
                here = range(first, first + part.num_rows)
                first += part.num_rows
                if cut:
                    texts = part.column(text)
                    if any(row in spans for row in here):
                        texts = pa.array([cleaned(t.encode(), spans[row]).decode() if row in spans else t for row, t in zip(here, texts.to_pylist())], texts.type)
                    yield pa.RecordBatch.from_arrays([texts if x == text else part.column(x) for x in names], names)
                else:
                    added = [pa.array(waiting.counts[here.start : here.stop], pa.int64()), pa.array([spans.get(row, []) for row in here], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(items.get(row, ())) for row in here], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *added], [*names, *(f.name for f in FOUND)])

        waiting = Waiting(own, text)
        for batch in batches:
            for part in cut_batches(batch, text):
                waiting.add(part)
                if waiting.shard.size >= SHARD or waiting.bytes > WAITING:
                    yield from done(waiting)
                    waiting = Waiting(own, text)
        yield from done(waiting)

    return mapped(docs, run, T.StructType(rest if cut else [*rest, *FOUND]))


def passes(docs: DataFrame, benchmark: DataFrame, width: int, text: str, item: str, item_text: str, cut: bool) -> DataFrame:
    """A pass for each block of windows; the last one cuts, if asked for."""
    held = windows(benchmark, width, item, item_text)
    blocks = max(1, -(-held.count() // BLOCK))
    if blocks > 1:
        held = written(held.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))), "windows")
    found = docs.drop(*(f.name for f in FOUND))
    for k in range(blocks):
        own = held.where(F.col("block") == k) if blocks > 1 else held
        phrases = Phrases([(r["window"].encode().split(b" "), r["items"]) for r in own.select("window", "items").collect()])
        last = k + 1 == blocks
        found = search(found, phrases, text, cut and last)
        found = found if last else written(found, "hits")
    return found


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds n_words, spans ([first, last + 1) of hit words, merged) and items (sorted as strings)."""
    return passes(docs, benchmark, width, text, item, item_text, cut=False)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with hit spans cut out of their text; other columns as they were. Columns named
    as in FOUND pass through."""
    mine = {f.name: f"_own_{f.name}" for f in FOUND if f.name in docs.columns}
    cut = passes(docs.withColumnsRenamed(mine), benchmark, width, text, item, item_text, cut=True)
    return cut.withColumnsRenamed({v: k for k, v in mine.items()}).select(*docs.columns)
