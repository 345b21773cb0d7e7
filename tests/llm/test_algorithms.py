"""The algorithms against brute force, without Spark."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from pagewright.llm import decontaminate, packing, quality, simhash, substring_dedup, suffixes, token_counts, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        order, ranks = suffixes.suffix_array(np.array(x, dtype=np.int64))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])

        def shared(a, b):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            return k

        want = [0] * bool(x) + [shared(a, b) for a, b in zip(order[1:].tolist(), order[:-1].tolist())]
        assert suffixes.common_prefixes(order, ranks).tolist() == want


def test_repetition():
    rng = random.Random(4)
    for _ in range(100):
        docs = [[bytes([97 + rng.randint(0, 3)]) for _ in range(rng.randint(0, 50))] for _ in range(rng.randint(1, 5))]
        three, covered, longest = quality.repetition(docs, 5)
        for k, w in enumerate(docs):
            n, rep, cov, top = len(w), set(), set(), 0
            for i in range(n):
                m = max([j for q in range(n) if q != i for j in range(n - max(i, q) + 1) if w[i : i + j] == w[q : q + j]] or [0])
                top = max(top, m)
                rep |= set(range(i, i + 3)) if m >= 3 else set()
                cov |= set(range(i, i + m)) if m >= 5 else set()
            assert (len(rep), len(cov), top) == (three[k], covered[k], longest[k])


def test_fm_index():
    rng = random.Random(5)
    for _ in range(60):
        letters = [b"a", b"b", b"c", b"d"]
        items = [(str(i), b" ".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))) for i in range(4)]
        held = {}
        for name, text in items:
            w = text.split()
            for i in range(max(1, len(w) - 2) if w else 0):
                held.setdefault(tuple(w[i : i + 3]), set()).add(name)
        phrases = decontaminate.Phrases([(list(w), sorted(x)) for w, x in held.items()])
        shard = decontaminate.Shard(phrases)
        docs = [[rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 50))] for _ in range(5)]
        for i, w in enumerate(docs):
            if phrases.shortest and len(w) >= phrases.shortest:
                shard.add(100 * i, np.array([phrases.number.get(x, 0) for x in w], dtype=np.int64))
        want = set()
        for name, text in items:
            w = text.split()
            for window in [w[i : i + 3] for i in range(max(1, len(w) - 2))] if w else []:
                want |= {(100 * i + a, len(window), phrases.names.index(name)) for i, d in enumerate(docs) for a in range(len(d) - len(window) + 1) if d[a : a + len(window)] == window}
        found = [(p, n, x) for n, places, windows in shard.hits() for p, w in zip(places.tolist(), windows.tolist()) for x in phrases.by_length[n][1][w]]
        assert sorted(found) == sorted(want)


def test_best_fit_is_that_of_items():
    rng = random.Random(6)
    for _ in range(100):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 20))}
        sequences, seen = {}, {}
        for length, rank, n, first, each, at in packing.best_fit(counts, 64):
            assert rank == seen.get(length, 0)
            seen[length] = rank + n
            for j in range(n):
                sequences.setdefault(first + j // each, []).append((at + j % each * length, length))
        assert seen == counts
        for held in sequences.values():
            end = 0
            for at, length in sorted(held):
                assert at == end
                end += length
            assert end <= 64
        rooms = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(64 - length)
        assert len(rooms) == len(sequences)


WORDS = ["the", "It's", "é", "naïve", "foo,", "a\n", "b\tc", "don't", "...", "x1y2", "  ", "\n\n", "Ｆ", "ß", "İ", "<|endoftext|>", "a<|startoftext|>b", "<|", "|>", "é", " ", "\x1c", "-"]


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "", "  ", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_and_edits(whole):
    rng = random.Random(7)
    tokenizer = packing.WordTokenizer(VOCABULARY)
    for k in range(150):
        text = text_of(rng, rng.choice([0, 1, 5, 100, 1500 if k % 40 == 0 else 20]))
        assert np.frombuffer(tokenizer.ids(text.encode()), "<u4").tolist() == whole(text)
        counted = token_counts.Counted.of(text, tokenizer)
        for _ in range(6):
            at, removed, put = rng.randint(-1, len(counted.text) + 2), rng.choice([0, 0, 1, 3, 40, 400]), rng.choice(["", text_of(rng, 1), text_of(rng, 3), text_of(rng, 600 if k % 50 == 0 else 2), "x", " "])
            a = min(max(0, at), len(counted.text))
            want = counted.text[:a] + put + counted.text[a + removed :]
            counted.edit(at, removed, put)
            counted = token_counts.Counted.stored(counted.text, counted.tree.chars, counted.tree.tokens, tokenizer)
            assert (counted.text, counted.tree.chars[1], counted.tree.tokens[1]) == (want, len(want), len(whole(want)))


def test_edits_encode_little():
    tokenizer = packing.WordTokenizer(VOCABULARY)
    counted = token_counts.Counted.of("some words here. " * 20_000, tokenizer)
    counted.edit(100_000, 5, "new ")
    assert 0 < counted.encoded < 4 * token_counts.LEAF


def test_texts_without_white_space_are_cut():
    rng = random.Random(17)
    tokenizer = packing.WordTokenizer(VOCABULARY)
    signs = "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(200)) + "\u3002\uff0c" * 20
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    library = Tokenizer.from_file(VOCABULARY)
    for letters in (signs, base64):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        counted = token_counts.Counted.of(text, tokenizer)
        for _ in range(40):
            at, removed, put = rng.randrange(20_000), rng.choice([0, 1, 2]), rng.choice(["", "x", "\u3002", "\u300d", "\u0301", "7", rng.choice(letters)])
            text = text[:at] + put + text[at + removed :]
            counted.edit(at, removed, put)
            assert counted.text == text
        assert counted.tree.tokens[1] == len(library.encode(text, add_special_tokens=False).ids)
        assert counted.encoded < 40 * 8 * token_counts.LEAF


def linked(fps, radius):
    top = list(range(len(fps)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius:
                top[root(a)] = root(b)
    return [root(i) for i in range(len(fps))]


def test_forests_span():
    rng = random.Random(8)
    refs = simhash.pivots()[:, None]
    for n in (2, 3, 10, 80) * 12:
        centres = [rng.getrandbits(64) for _ in range(6)]
        fps = np.unique(np.array([rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)], dtype=np.uint64))
        edges = simhash.forest(fps[:, None], 4, refs) if len(fps) > 1 else []
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in edges)
        want = linked(fps, 4)
        assert len(edges) == len(fps) - len(set(want))
        assert len({frozenset(i for i in range(len(fps)) if want[i] == r) for r in want}) == len(set(want))


def test_block_keys_miss_no_link():
    rng = random.Random(9)
    for n in (10, 10**5, 10**9):
        masks, _ = simhash.block_keys(n, 4)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def shortened(docs, groups):
    tables = [pa.table({"doc_id": pa.array([k for k, _ in docs if k % groups == g], pa.int64()), "text": pa.array([t.decode("latin1") for k, t in docs if k % groups == g])}) for g in range(groups)]
    held = [substring_dedup.Group(t, "doc_id", "text") for t in tables]
    pick = lambda t, name, v: t.filter(pc.equal(t[name], v))
    sent = pa.concat_tables([substring_dedup.send_hashes(g, i, 3) for i, g in enumerate(held)])
    masks = pa.concat_tables([substring_dedup.shared_hashes(pick(sent, "bucket", b)) for b in range(3)])
    runs = pa.concat_tables([substring_dedup.send_runs(g, pick(masks, "t", i), i, 3, np.array([b"b", b"c"], "S16")) for i, g in enumerate(held)])
    none = pa.table({"t": pa.array([], pa.int32()), "places": pa.array([], pa.binary()), "masks": pa.array([], pa.binary())})
    found = pa.concat_tables([none, *(substring_dedup.repeated(pick(runs, "range", r)) for r in set(runs["range"].to_pylist()))])
    out = [substring_dedup.cut_out(g, pick(found, "t", i), pa.int64(), "doc_id") for i, g in enumerate(held)]
    return sorted((k, kept) for o in out for k, kept in zip(o["doc_id"].to_pylist(), o["kept"].to_pylist()))


def brute_dedup(docs):
    first = {}
    for k, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], 1 << 62), k)
    out = []
    for k, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        out.append((k, bytes(c for c, x in zip(t, gone) if not x)))
    return sorted(out)


def test_substring_dedup():
    rng = random.Random(10)
    for k in range(60):
        letters = b"abcd" if k % 3 else b"ab"
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(30, 400))) for _ in range(4)]
        docs = []
        for d in range(rng.randint(1, 14)):
            t = b""
            for _ in range(rng.randint(0, 4)):
                b = rng.choice(base)
                i = rng.randint(0, len(b) - 1)
                t += b[i : rng.randint(i, len(b))] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 20)))
            docs.append((d, b"a" * rng.randint(0, 200) if rng.random() < 0.1 else t))
        docs += [(100 + d, t) for d, t in docs] if rng.random() < 0.3 else []
        assert shortened(docs, 3) == brute_dedup(docs)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(11)
    for _ in range(60):
        runs, texts = [], []
        for _ in range(rng.randint(1, 9)):
            held = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 12))})
            runs.append((held, bytes([0, *(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(held, held[1:]))][: len(held)])))
            texts += held
        run, row, share = substring_dedup.merge(runs)
        out = [runs[r][0][k] for r, k in zip(run, row)]
        assert out == sorted(texts)
        for a, b, s in list(zip(out, out[1:], share[1:])):
            assert a[:s] == b[:s] and (len(a) == s or len(b) == s or a[s] != b[s])


def test_record_bounds():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n\r\n\r\nWARC/\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [data[a:b] for _, a, b in warc.records_of(data)] == [b"\r\n\r\nWARC/", b""]
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-1]))
