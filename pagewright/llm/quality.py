"""Quality rules with suffix-array repetition.

Words are runs of bytes other than the six white-space characters. Documents are taken in groups of
about a million words; a symbol is a word within its document, so one suffix array sorts the
suffixes of all documents of the group and no repeat crosses them. The longest common prefixes of
neighbours give every word's innermost interval, whose value is the longest string from there that
also starts elsewhere in the document. The union of those spans of ``min_repeat`` words or more is
the union of all maximal repeated substrings; a document is rejected if they cover more than
``max_covered`` of its words or if the longest is more than ``max_longest`` of them. The base rule's
repeated three-word windows are read off the same array.

Every document is judged alone, so its neighbours and the cut into groups don't matter: no shuffle,
no state. Nulls and empty texts have no words and fail the base rule. A text of any length is
sorted whole. Repeated rows are judged one by one, and equal texts get equal verdicts. An empty table
gives an empty result. Columns of other names pass through; those of the names in FIELDS are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE, chunks, cut_batches, mapped
from .suffixes import common_prefixes, longest_repeats, suffix_array

#: Words that a repeated substring has at least; the part of a document's words that such
#: substrings may cover; the part that one of them may have.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.35, 0.25

MIN_WORDS, MAX_REPEAT_WORDS = 50, 0.5

SYMBOLS = b"#*$%&|<>"

#: Words that are sorted together, about.
TOGETHER = 1 << 19

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    count = 0
    for line in lines:
        if line in seen:
            count += bool(line.strip(SPACE))
        else:
            seen.add(line)
    return count


def span_sums(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Covered places of each document; at: where documents begin, and n at the end."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    sums = np.r_[0, np.cumsum(np.cumsum(edge[:n]) > 0)]
    return sums[at[1:]] - sums[at[:-1]]


def repetition(words: list[list[bytes]], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: words in repeated three-word windows, words in maximal repeats of
    min_repeat or more, words of the longest repeat."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    n = int(at[-1])
    if not n:
        return (np.zeros(len(words), np.int64),) * 3
    number: dict[bytes, int] = {}
    symbol = np.empty(n, np.int64)
    for k, held in enumerate(words):
        symbol[at[k] : at[k + 1]] = [number.setdefault(w, len(number)) for w in held]
    symbol += np.repeat(np.arange(len(words), dtype=np.int64), sizes) * max(1, len(number))
    order, ranks = suffix_array(symbol)
    longest = longest_repeats(order, common_prefixes(order, ranks))
    three = np.flatnonzero(longest >= 3)
    repeat_words = span_sums(three, np.full(len(three), 3), at, n)
    long = np.flatnonzero(longest >= min_repeat)
    covered = span_sums(long, longest[long], at, n)
    top = np.zeros(len(words), np.int64)
    filled = sizes > 0
    top[filled] = np.maximum.reduceat(longest, at[:-1][filled])
    return repeat_words, covered, top


def judge(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, keep_text: bool = False) -> DataFrame:
    """Adds the counts and verdicts of FIELDS to the rows; text itself stays if keep_text."""
    mine = {f.name for f in FIELDS}
    rest = [f for f in docs.schema.fields if f.name not in mine and (keep_text or f.name != text)]
    names = [f.name for f in rest]
    docs = docs.select(*names, *([] if keep_text else [text]))

    def measured(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = chunks(part.column(text))
        words = [x.split() for x in texts]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        chars = pc.fill_null(pc.utf8_length(part.column(text)), 0).to_numpy(zero_copy_only=False)
        spaces = np.array([len(x) - len(x.translate(None, SPACE)) for x in texts], dtype=np.int64)
        symbols = np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], dtype=np.int64)
        lines = np.array([dup_lines(x) for x in texts], dtype=np.int64)
        repeats, covered, longest = repetition(words, min_repeat)
        failed = (n_words < MIN_WORDS) | (100 * repeats > 100 * MAX_REPEAT_WORDS * n_words)
        kept = ~failed & (covered <= max_covered * n_words) & (np.where(longest >= min_repeat, longest, 0) <= max_longest * n_words)
        columns = [n_words, chars.astype(np.int64) - spaces, symbols, lines, repeats, covered, longest, failed, kept]
        return pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *map(pa.array, columns)], [*names, *(f.name for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batches(batch, text, 6 * TOGETHER):
                yield measured(part)

    return mapped(docs, run, T.StructType([*rest, *FIELDS]))
