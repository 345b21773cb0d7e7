"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised once into pieces of at most ``limit`` ids (only longer ones are cut) and the
pieces are written to shared storage. Planning sees counts, not documents: best-fit decreasing takes
lengths from the longest down, and opened sequences are kept as classes of equal free room, so one
step places as many pieces as a class can take. The plan is a list of slot ranges: piece number j of
a length, in the order of its rank, stands in a sequence and at an offset that follow from j. Its
size depends on the number of different lengths, never on the number of documents. Documents take
their slots by joining on rank within length.

Ranks are taken per (length, salt) and shifted by the counts of the salts before, so that a length
that a third of the pieces share is ranked in many tasks.

Null and empty texts are one piece that holds the end id alone. Texts of any length are cut into as
many pieces as they need. Pieces of equal length are ranked in the order of key, piece and what else
their rows hold. Rows with a null or repeated key are packed like any other, and are spread by their own hash. An
empty table gives an empty result. Of the documents only the key and the text are read, so their other
columns, of whatever names, have no effect.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut_batches, mapped, written

#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 200_000

#: Bytes, about, that each of the two generations of a worker's memory of chunks, and of words, takes,
#: with what Python needs for an entry. Longer chunks than REMEMBERED are encoded each time.
CHUNKS, WORDS, ENTRY, REMEMBERED = 18 << 20, 36 << 20, 200, 1024

#: Letters that NFC leaves alone and that lower-case one by one, then signs. Whatever else a
#: chunk holds, the tokenizer itself gets it whole.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ć]*)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory:
    """Values by key, in two generations of limit bytes each, about: what wasn't asked for since the
    last change goes."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.held = make, limit, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key) -> bytes:
        """To be called when the key isn't in new."""
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) > REMEMBERED:
            return found
        if self.held >= self.limit:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = found
        self.held += len(key) + len(found) + ENTRY
        return found


class WordTokenizer:
    """The ids of texts by a word-level BPE file, remembered per white-space chunk.

    The file drops white space, so no token crosses it and a text's ids are those of its chunks
    in turn. Chunks of plain letters and signs go to the model at once; others to the tokenizer,
    special tokens among them, which hold letters between signs and no white space. The strings of
    special tokens get their ids, as the library's own call gives them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.chunks, self.words = Memory(self.chunk, CHUNKS), Memory(self.spelt, WORDS)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def spelt(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def word(self, word: str) -> bytes:
        return found if (found := self.words.new.get(word)) is not None else self.words.get(word)

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if m := PLAIN.fullmatch(text):
            return (self.word(m[1].lower()) if m[1] else b"") + (self.word(m[2]) if m[2] else b"")
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes) -> bytes:
        """As little-endian unsigned 32-bit numbers."""
        chunks = self.chunks
        return b"".join([x if (x := chunks.new.get(w)) is not None else chunks.get(w) for w in text.split()])


def pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids (binary, little-endian unsigned 32-bit) of every document."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            for part in cut_batches(batch, text, 4 << 20):
                rows, numbers, cut = [], [], []
                for i, x in enumerate(chunks(part.column(text))):
                    ids = tokenizer.ids(x) + end
                    for n, at in enumerate(range(0, len(ids), 4 * limit)):
                        rows.append(i)
                        numbers.append(n)
                        cut.append(ids[at : at + 4 * limit])
                piece = np.array(numbers, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(rows, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * limit), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(cut, pa.binary())],
                    out.names,
                )

    return mapped(docs.select(key, text), run, out)


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, n, first sequence, pieces a sequence, offset).

    Best-fit decreasing: each piece goes where it leaves the least room. Sequences of equal room
    are one class; a class takes as many pieces of a length as fit before another is looked at,
    for its room stays the smallest that fits.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, n)]
    sizes: list[int] = []  # the rooms that have sequences, sorted
    plan, opened = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if not rooms.get(room):
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                room = sizes[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del sizes[at]
            else:
                room, first = limit, opened
                n = -(-left // (limit // length))
                opened += n
            each = room // length
            used = min(n, -(-left // each))
            give(room, first + used, n - used)
            taken = min(left, used * each)
            plan.append((length, rank, taken, first, each, limit - room))
            full, rest = divmod(taken, each)
            give(room - each * length, first, full)
            if rest:
                give(room - rest * length, first + full, 1)
            left -= taken
            rank += taken
    return plan


def assign(found: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to written pieces. Only key, piece, length and what else the
    rows carry beside ids should be handed in: all of it is exchanged once."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, limit)
    salts = max(8, -(-sum(counts.values()) // RANKED_TOGETHER))
    # By all that a row holds, so that pieces of null or repeated keys are spread as well.
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(*found.columns), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(key, "piece", *(x for x in found.columns if x not in (key, "piece", "ids")))
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    # Slot ranges are looked up by length, then by the last range that starts at the rank or before.
    schema = "length long, ranges array<struct<a: long, n: long, seq: long, each: long, at: long>>"
    held: dict[int, list] = {}
    for length, rank, n, first, each, at in plan:
        held.setdefault(length, []).append((rank, n, first, each, at))
    slots = spark.createDataFrame([(k, v) for k, v in held.items()], schema)
    step = F.col("_rank") - F.col("_slot.a")
    joined = ranked.join(F.broadcast(slots), "length").withColumn("_slot", F.element_at(F.filter("ranges", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["a"] + r["n"])), 1))
    return joined.withColumns({"sequence_id": F.col("_slot.seq") + F.floor(step / F.col("_slot.each")), "offset": F.col("_slot.at") + step % F.col("_slot.each") * F.col("length")}).drop("_salt", "_first", "_rank", "_slot", "ranges")


def pack(docs: DataFrame, path: str, limit: int = 4096, end_id: int | None = 1, derive: dict[str, Column] | None = None, keep_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, piece, start, length, sequence_id, offset, the ids if keep_ids, and
    the columns that derive computes from ids."""
    rows = pieces(docs, path, limit, end_id, key, text).withColumns(derive or {})
    stored = written(rows if keep_ids else rows.drop("ids"), "pieces")
    return assign(stored, limit, key)


def normal(text: str) -> str:
    """For tests: the text as the tokenizer file sees it."""
    return unicodedata.normalize("NFC", text).lower()
