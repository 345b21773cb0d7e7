"""The registered queries over small tables, each against brute force by its contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import BASE, NEAR, judged, print_of, prose
from tokenizers import Tokenizer

from pagewright.llm import queries, sharding

r = random.Random(21)
PASSAGE = prose(40, r)
TEXTS = [None, "", " \n\t", "one", BASE, BASE, " ".join(NEAR), prose(60, r), "same line\n" * 40, "é ß 汉字 " * 30, "x" * 3000]
TEXTS += [f"{prose(30, r)} {PASSAGE} {prose(30, r)}" for _ in range(6)] + ["7 " * 9000, "a <|endoftext|> b<|startoftext|>c", prose(150, r) + PASSAGE + PASSAGE]
TEXTS += [prose(r.randint(1, 120), r) for _ in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(3 * i + 1, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


DOCS = [(3 * i + 1, t or "") for i, t in enumerate(TEXTS)]


def test_op3(spark, folder):
    library = Tokenizer.from_file(queries.vocabulary())
    found = queries.op3_best_fit_packing(spark, folder).collect()
    by_id, sequences = {}, {}
    for x in sorted(found, key=lambda x: (x.doc_id, x.piece)):
        by_id.setdefault(x.doc_id, []).append(x)
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(by_id) == [k for k, _ in DOCS]
    lengths = []
    for k, t in DOCS:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        cuts = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert [(x.piece, x.start, x.length, x.ids_crc32) for x in by_id[k]] == [(i, 4096 * i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cuts)]
        lengths += map(len, cuts)
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [at for at, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 4096
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(4096 - n)
    assert len(sequences) == len(rooms)


def test_op5(spark, folder):
    library = Tokenizer.from_file(queries.vocabulary())
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)

    def hashed(k, doc_id, most):
        seed = xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), 42)
        value = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), seed)
        return (value - (1 << 64) if value >= 1 << 63 else value) % most

    found = {x.doc_id: x for x in queries.op5_edit_counts(spark, folder).collect()}
    assert len(found) == len(DOCS)
    for (k, t), own in zip(DOCS, TEXTS):
        n = max(len(t), 1)
        edits = [(hashed(1, k, n), hashed(2, k, 40), "an edit, newly written "), (hashed(3, k, n), 0, (own or "")[:25]), (hashed(4, k, n), 12, "")]
        new = t
        for at, removed, put in edits:
            at = min(at, len(new))
            new = new[:at] + put + new[at + removed :]
        x = found[k]
        assert (x.n_before, x.n_after, x.n_chars) == (count(t), count(new), len(new))
        assert x.n_encoded <= 3 * 6000 + 100


def sequential_ring(points, cells, n_shards, bits, load_factor):
    """Cells of (cell, size) one after another by the rounds that the module describes."""
    order = {}
    for cell, _ in cells:
        ahead = {}
        for s in range(n_shards):
            ahead[s] = min((((p >> 64 - bits) + ((p >> 64 - bits) < cell) * (1 << bits), p >> 1) for p in points[s]))
        order[cell] = sorted(ahead, key=lambda s: (*ahead[s], s))
    fair = -(-sum(n for _, n in cells) // n_shards)
    loads, placed, waiting = [0] * n_shards, {}, sorted(cells)
    for limit in (int(fair * load_factor), int(fair * load_factor) + max(n for _, n in cells)):
        for turn in range(n_shards):
            asked, left = [0] * n_shards, []
            gained = [0] * n_shards
            for cell, n in waiting:
                s = order[cell][turn]
                asked[s] += n
                if loads[s] + asked[s] <= limit:
                    placed[cell] = s
                    gained[s] += n
                else:
                    left.append((cell, n))
            loads = [a + b for a, b in zip(loads, gained)]
            waiting = left
    return placed


@pytest.mark.parametrize("n_shards", [3, 8])
def test_ring_against_a_sequential_one(spark, n_shards):
    bits = 8
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    size = F.octet_length("text") + 1
    found = sharding.shard(docs.withColumn("cell", sharding.cell_of(F.col("doc_id").cast("string"), bits)), n_shards, size, cell_bits=bits).collect()
    cells = {}
    for x in found:
        cells[x.cell] = cells.get(x.cell, 0) + x.size
    points = {}
    for x in sharding.ring(spark, n_shards).collect():
        points.setdefault(x["shard"], []).append(x.place % (1 << 64))
    placed = sequential_ring(points, list(cells.items()), n_shards, bits, 1.001)
    assert all(x["shard"] == placed[x.cell] for x in found)


def test_op6(spark, folder):
    found = queries.op6_bounded_ring(spark, folder).collect()
    own = {x.doc_id: x for x in found}
    assert len(found) == len(DOCS)
    for k, t in DOCS:
        assert (own[k].size, own[k].text_crc32, own[k].law, own[k].grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
    for s in range(8):
        slots = sorted(x.slot for x in found if x["shard"] == s)
        assert slots == list(range(len(slots)))
    points, cells = {}, {}
    for x in sharding.ring(spark, 8).collect():
        points.setdefault(x["shard"], []).append(x.place % (1 << 64))
    cell = {x.doc_id: x.cell for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", sharding.cell_of(F.col("doc_id").cast("string"), 16).alias("cell")).collect()}
    for k, t in DOCS:
        cells[cell[k]] = cells.get(cell[k], 0) + len(t.encode()) + 1
    placed = sequential_ring(points, list(cells.items()), 8, 16, 1.001)
    assert {k: own[k]["shard"] for k, _ in DOCS} == {k: placed[cell[k]] for k, _ in DOCS}


def test_op7(spark, folder):
    found = {x.doc_id: x for x in queries.op7_quality_rules(spark, folder).collect()}
    for k, t in DOCS:
        x, want = found[k], judged(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        w = t.split()
        if len(w) > 500:
            continue
        covered, longest = set(), 0
        for a in range(len(w)):
            for b in range(a):
                m = 0
                while a + m < len(w) and w[a + m] == w[b + m]:
                    m += 1
                if m >= 10:
                    covered |= {*range(a, a + m), *range(b, b + m)}
                    longest = max(longest, m)
        assert x.kept == (not x.base_failed and len(covered) <= 0.35 * len(w) and longest <= 0.25 * len(w))


def test_op8(spark, folder):
    first = {}
    for k, t in DOCS:
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    found = {x.doc_id: x for x in queries.op8_suffix_dedup(spark, folder).collect()}
    assert len(found) == len(DOCS)
    for k, t in DOCS:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) > 0))
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op10(spark, folder):
    prints = {k: print_of(t) for k, t in DOCS}
    component = {k: k for k in prints}
    for _ in prints:
        before = dict(component)
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[a] = min(component[a], component[b])
        if component == before:
            break
    found = {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op10_simhash(spark, folder).collect()}
    assert found == {k: (f"{p:016x}", component[k]) for k, p in prints.items()}
