"""Edit-aware token counts with segment trees over pre-tokens.

A document's text is cut into leaves of about LEAF characters, always where no pre-token can cross:
after white space, after a digit (which is a pre-token of its own), and between an ideographic stop
and an ideograph or kana. A leaf is a run of whole pre-tokens, so a single pre-token longer than that
is a leaf of its own. The segment tree holds, for every node, the characters and tokens below it, so
the root has the document's token count. An edit (place, characters removed, text put in) descends
by characters to the leaves that it touches; only their text is encoded again, with a neighbour leaf
as boundary context where the edit let a pre-token cross the boundary, and sums change on the paths
to the root. A leaf that has grown too long is cut anew, and only its text is encoded.

Trees are a column beside the text, so they can be stored with it (``build``) and edits applied
whenever they come (``update``); ``counted`` does both in one pass. All are projections, without a
shuffle. Edits of a row apply in turn, each to the result of the one before. Places beyond the end are
the end, negative ones the start; null edits and null texts put in count as nothing.

Null and empty texts have an empty tree and no tokens; an edit of a null text starts from an empty
one. Texts of any length are counted whole. Repeated rows are counted one by one, and equal texts with
equal edits get equal counts. An empty table gives an empty result. Columns of other names pass
through; those that a function adds replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cut_batches, mapped
from .packing import WordTokenizer

LEAF, LONGEST_LEAF = 256, 2048

SPACES = " \t\n\r\x0b\x0c"
DIGITS = "0123456789"
STOPS = "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
LETTERS = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
GAP = re.compile(f"[{SPACES}]+|[{DIGITS}]|[{STOPS}](?=[{LETTERS}])")
AFTER_STOP = re.compile(f"[{LETTERS}]")

TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDITS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("put", T.StringType())]))


def leaves_of(text: str) -> list[str]:
    """Parts of a text that end where no pre-token can cross, but for the last."""
    found, at = [], 0
    while at < len(text):
        gap = GAP.search(text, at + LEAF)
        end = gap.end() if gap else len(text)
        found.append(text[at:end])
        at = end
    return found


def crosses(left: str, right: str) -> bool:
    """Whether a pre-token may hold both of these neighbouring characters."""
    return not (left in SPACES or left in DIGITS or left in STOPS and AFTER_STOP.match(right))


class Tree:
    """Sums of characters and tokens in heap order: node i has 2 i and 2 i + 1 below it."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.chars, self.tokens = self.sums(chars), self.sums(tokens)

    def sums(self, values: list[int]) -> list[int]:
        level = np.zeros(self.size, np.int64)
        level[: len(values)] = values
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @classmethod
    def stored(cls, chars: list[int], tokens: list[int]) -> Tree:
        tree = cls.__new__(cls)
        tree.size, tree.chars, tree.tokens = len(chars) // 2, list(chars), list(tokens)
        return tree

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, and the leaf's first character. The end
        of the text belongs to the last leaf with characters."""
        if at >= self.chars[1]:
            node, first = 1, 0
            while node < self.size:
                node *= 2
                if self.chars[node + 1]:
                    first += self.chars[node]
                    node += 1
            return node - self.size, first
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if at - first >= self.chars[node]:
                first += self.chars[node]
                node += 1
        return node - self.size, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more, further = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += further
            node >>= 1

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size :], self.tokens[self.size :]


class Counted:
    """A text as the parts in the leaves of its tree, and how many characters were encoded since it
    was made."""

    def __init__(self, parts: list[str], tree: Tree, tokenizer: WordTokenizer):
        self.tree, self.tokenizer, self.encoded = tree, tokenizer, 0
        self.parts = parts + [""] * (tree.size - len(parts))

    @classmethod
    def of(cls, text: str, tokenizer: WordTokenizer) -> Counted:
        parts = leaves_of(text)
        return cls(parts, Tree([len(p) for p in parts], [len(tokenizer.ids(p.encode())) // 4 for p in parts]), tokenizer)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], tokenizer: WordTokenizer) -> Counted:
        tree = Tree.stored(chars, tokens)
        ends = np.cumsum(tree.leaves()[0]).tolist()
        return cls([text[a:b] for a, b in zip([0, *ends], ends)], tree, tokenizer)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.tokenizer.ids(text.encode())) // 4

    def edit(self, at: int, removed: int, put: str) -> None:
        tree, parts = self.tree, self.parts
        n = tree.chars[1]
        at = min(max(0, at), n)
        end = at + min(max(0, removed), n - at)
        if at == end and not put:
            return
        first, begin = tree.find(at)
        last = tree.find(end - 1)[0] if end > at else first
        region = "".join(parts[first : last + 1])
        new, region_end = region[: at - begin] + put + region[end - begin :], begin + len(region)
        while True:  # neighbours join as long as a pre-token may cross the region's bounds
            before = tree.find(begin - 1) if begin else None
            left = parts[before[0]][-1] if before else ""
            after = tree.find(region_end)[0] if region_end < n else None
            inner = new[-1:] or left
            if after is not None and inner and crosses(inner, parts[after][0]):
                new += parts[after]
                region_end += len(parts[after])
                last = after
            elif before and new and crosses(left, new[0]):
                new = parts[before[0]] + new
                first, begin = before
            else:
                break
        if len(new) > LONGEST_LEAF:
            own = leaves_of(new)
            chars, tokens = tree.leaves()
            held = [*zip(parts[:first], tokens[:first]), *((p, self.count(p)) for p in own), *zip(parts[last + 1 :], tokens[last + 1 :])]
            held = [(p, t) for p, t in held if p]
            self.tree = Tree([len(p) for p, _ in held], [t for _, t in held])
            self.parts = [p for p, _ in held] + [""] * (self.tree.size - len(held))
            return
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
            parts[leaf] = ""
        tree.put(first, len(new), self.count(new))
        parts[first] = new

    def apply(self, edits: list[dict | None] | None) -> Counted:
        for e in edits or ():
            if e is not None:
                self.edit(e["at"] or 0, e["removed"] or 0, e["put"] or "")
        return self


KIND = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def trees(held: list[Counted]) -> list[pa.Array]:
    """Columns tree and n_tokens."""
    return [pa.array([{"chars": x.tree.chars, "tokens": x.tree.tokens} for x in held], KIND), pa.array([x.tree.tokens[1] for x in held], pa.int64())]


def build(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds tree and n_tokens to the rows."""
    rest = [f for f in docs.schema.fields if f.name not in ("tree", "n_tokens")]
    out = T.StructType([*rest, T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            for part in cut_batches(batch, text):
                made = [Counted.of(x or "", tokenizer) for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), *trees(made)], out.names)

    return mapped(docs, run, out)


def update(counted: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Applies each row's edits: text, tree and n_tokens are those of the edited text, and
    n_encoded (characters encoded again) is added; edits goes."""
    keep = [f for f in counted.schema.fields if f.name not in (edits, text, "tree", "n_tokens", "n_encoded")]
    out = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType()), T.StructField("n_encoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            for part in cut_batches(batch, text):
                columns = (part.column(x).to_pylist() for x in (text, "tree", edits))
                done = [Counted.stored(x or "", tree["chars"], tree["tokens"], tokenizer).apply(e) for x, tree, e in zip(*columns)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array([d.text for d in done], pa.string()), *trees(done), pa.array([d.encoded for d in done], pa.int64())], out.names)

    return mapped(counted, run, out)


def counted(docs: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """build and update in one pass: adds n_before and n_tokens, the counts before and after the
    edits, and n_encoded; text is the edited one, edits goes."""
    mine = ("n_before", "n_tokens", "n_encoded")
    keep = [f for f in docs.schema.fields if f.name not in (edits, text, *mine)]
    out = T.StructType([*keep, T.StructField(text, T.StringType()), *(T.StructField(x, T.LongType()) for x in mine)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            for part in cut_batches(batch, text):
                texts, before, after, encoded = [], [], [], []
                for x, e in zip(part.column(text).to_pylist(), part.column(edits).to_pylist()):
                    held = Counted.of(x or "", tokenizer)
                    before.append(held.tree.tokens[1])
                    held.apply(e)
                    texts.append(held.text)
                    after.append(held.tree.tokens[1])
                    encoded.append(held.encoded)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (before, after, encoded))], out.names)

    return mapped(docs, run, out)
