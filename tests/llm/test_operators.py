"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
columns whose names clash."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, line_dedup, packing, quality, queries, sharding, simhash, substring_dedup, token_counts, url_filter, warc

rng = random.Random(1)
VOCAB = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


LONG = prose(30_000)
BASE = prose(200)
NEAR = BASE.split(" ")
NEAR[100] = "changed"
TEXTS = [None, "", " \n\t", "one", BASE, BASE, " ".join(NEAR), LONG, prose(60), "same line\n" * 40, "é ß 汉字 " * 30, prose(400), "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en", 1.5, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[0], (None, BASE, "s1", None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, component double, shard int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 300
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (1, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for k, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and html == big and k != 1
        want.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert found == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0
    warc.write(pages.where("page_id in (1, 2, 3, 8)").dropDuplicates(["page_id"]), str(tmp_path / "a"))
    warc.rewrite(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    again = warc.resolve(warc.read(spark, str(tmp_path / "b")))
    assert {(r.record_id, r.record_type, r.original, r.payload_bytes) for r in again.collect()} == {("1", "response", None, 303), ("2", "revisit", "1", 303), ("3", "revisit", "1", 303), ("8", "response", None, 320)}


def test_no_archive_passes_its_bound(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "x" * (200_000 if i % 50 == 7 else 40 if i % 3 else 900)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"), file_bytes=100_000, most_bytes=700_000)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("part-*")]
    assert max(map(len, files)) <= 700_000 and len(files) < 60
    found = {(int(r.record_id), bytes(r.payload).decode()) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert found == {(k, html) for k, _, html in rows}


def test_line_dedup(spark, docs, none, monkeypatch):
    pages = [(i, f"boiler\nown {i}\n\nboiler" if i < 12 else "rare\nboiler", "h") for i in range(200)]
    pages += [(1000 + i, "boiler\nx", "small") for i in range(5)] + [(2000, None, "h"), (2001, "", None), (2002, "\n\n", "h")]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert found[0].text == "own 0\n" and (found[0].n_lines, found[0].n_dropped) == (3, 2)
    assert found[50].text == "" and found[1000].text == "boiler\nx"
    assert found[2000].text is None and found[2001].text == "" and found[2002].text == "\n\n"
    assert len(found) == len(pages)
    plain = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(docs).collect()), key=str)
    lines = [t.split("\n") if t is not None else [] for t in (r.text for r in docs.collect())]
    assert plain == sorted(((r.doc_id, r.text, sum(x.strip(" ") != "" for x in held), 0) for r, held in zip(docs.collect(), lines)), key=str)
    assert line_dedup.drop_boilerplate(none).collect() == []
    own = lambda: sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()), key=str)
    joined = own()
    monkeypatch.setattr(line_dedup, "small", lambda found: False)
    assert own() == joined and any(x[3] for x in joined)


def test_packing(docs, none):
    limit = 64
    found = packing.pack(docs, queries.vocabulary(), limit, 1, {"crc": F.crc32("ids")}).collect()
    tokenizer = packing.WordTokenizer(queries.vocabulary())
    whole = {r.doc_id: tokenizer.ids((r.text or "").encode()) + b"\1\0\0\0" for r in docs.where("doc_id is not null and doc_id not in (0, 4)").collect()}
    for k, ids in whole.items():
        own = sorted((r for r in found if r.doc_id == k), key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == ids and [r.start for r in own] == [limit * i for i in range(len(own))]
        assert all(r.length == limit for r in own[:-1]) and all(r.crc == zlib.crc32(r.ids) for r in own)
    sequences = {}
    for r in found:
        assert r.length == len(r.ids) // 4
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= limit
    assert packing.pack(none, queries.vocabulary()).count() == 0


def hits(text, items, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        for win in [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []:
            for a in range(len(words) - len(win) + 1):
                if words[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontaminate(spark, docs, none):
    items = [(11, BASE[50:400]), (9, "One"), (10, None), (12, ""), (13, "汉字 é"), (9, "zzz " + prose(3)), (14, LONG[70_000:70_300].upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs.withColumn("spans", F.lit(1)), benchmark).collect()
    assert len(found) == docs.count()
    want = {t: hits(t, items) for t in {r.text for r in found}}
    for r in found:
        assert (r.n_words, sum(b - a for a, b in r.spans), r["items"]) == want[r.text]
    cleaned = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark).collect()}
    assert BASE[60:380] not in cleaned[4] and cleaned[8] == TEXTS[8] and cleaned[0] is None and cleaned[3] == ""
    assert decontaminate.find(none, benchmark).count() == 0
    assert {len(r["items"]) for r in decontaminate.find(docs, benchmark.where("false")).collect()} == {0}


def test_phrase_blocks_add_up(spark, docs, monkeypatch):
    items = [(i, prose(30)) for i in range(6)] + [(100, BASE[50:400]), (101, LONG[1000:1300])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, str(r.spans), str(r["items"])) for r in decontaminate.find(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 700)
    assert {(r.doc_id, str(r.spans), str(r["items"])) for r in decontaminate.find(docs, benchmark).collect()} == one


def test_token_counts(spark, docs, none):
    edits = F.array(F.struct(F.lit(3).cast("long").alias("at"), F.lit(2).cast("long").alias("removed"), F.lit("new words ").alias("put")), F.lit(None))
    counted = token_counts.build(docs.withColumn("tree", F.lit(1)), queries.vocabulary()).withColumn("edits", edits.cast(token_counts.EDITS))
    tokenizer = packing.WordTokenizer(queries.vocabulary())
    for r in token_counts.update(counted, queries.vocabulary()).collect():
        assert r.n_tokens == len(tokenizer.ids(r.text.encode())) // 4 == r.tree.tokens[1]
    assert token_counts.build(none, queries.vocabulary()).count() == 0


def test_sharding(spark, docs, none):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    found = sharding.shard(docs, 4, size, cell_bits=10).collect()
    assert len(found) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none, 4, size, cell_bits=8).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    loads = {n: {r["shard"]: r.load for r in sharding.shard(many, n, size, cell_bits=12).groupBy("shard").agg(F.sum("size").alias("load")).collect()} for n in (8, 9)}
    for n, own in loads.items():
        fair = sum(own.values()) / n
        assert len(own) == n and max(own.values()) < 1.02 * fair and min(own.values()) > 0.95 * fair
    a, b = (sharding.shard(many, n, size, cell_bits=12).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (8, 9))
    assert a.join(b, "doc_id").where("s8 <> s9").count() < 0.2 * 20_000


def judged(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {k for held in windows.values() if len(held) > 1 for i in held for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(line in seen and re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_quality(docs, none):
    found = quality.judge(docs.withColumn("kept", F.lit(1)), keep_text=True).collect()
    for r in found:
        want = judged(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in found if r.kept}
    assert {4, 6, 7, 8, 11} <= kept and not kept & {0, 1, 2, 3, 9, 10, 12}
    assert quality.judge(none).count() == 0


def test_substring_dedup(docs, none):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    first = {}
    for k, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 62), 1 << 61 if k is None else k)
    want = []
    for k, t in rows:
        b, own = t.encode(), 1 << 61 if k is None else k
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < own:
                gone[i : i + 50] = True
        want.append((k, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    found = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert substring_dedup.dedup(none).count() == 0


URLS = {
    "http://a.org/x": ("a.org", "/x", "org/", "allow"),
    "http://EXAMPLE.org/es/1?q#h": ("example.org", "/es/1", "example.org/es/", "block"),
    "http://m.example.org/en/17": ("m.example.org", "/en/17", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "https://casino.com/fr/": ("casino.com", "/fr/", "com/fr/", "allow"),
    "https://x.com/de/a/b": ("x.com", "/de/a/b", "com/de/", "block"),
    "https://x.com/DE/": ("x.com", "/DE/", None, "allow"),
    "https://my-casino.net/": ("my-casino.net", "/", None, "block"),
    "https://casinos.net/": ("casinos.net", "/", None, "allow"),
    "https://m.ads-track.x.net/a": ("m.ads-track.x.net", "/a", None, "block"),
    "https://x.net/free/bets": ("x.net", "/free/bets", None, "allow"),
    "https://x.net/" + "a-" * 20_000 + "cheappills/": ("x.net", "/" + "a-" * 20_000 + "cheappills/", None, "block"),
    "http://a.org?x/y": ("a.org", "", None, "allow"),
    "no scheme casino": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://ÄB.org/é\n": ("Äb.org", "/é\n", "org/", "allow"),
}


def test_url_filter(spark):
    pages = spark.createDataFrame([(u, 1) for u in URLS] * 2, "url string, rule int")
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES
    found = url_filter.judge(pages, rules).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert (r.host, r.path, r["rule"], r.verdict) == URLS[r.url]
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    filed = url_filter.index(rules, {"org": 9, "example": 2, "es": 1})
    assert [r.name for r in filed["es"]] == ["example.org/es/"]
    assert {(r["rule"], r.verdict) for r in url_filter.judge(pages, ()).collect()} == {(None, "allow")}
    with pytest.raises(ValueError):
        url_filter.buckets({"a": [url_filter.Rule("\x1f", "block", "a", ("a",))]})


def test_url_index_misses_no_rule(spark):
    r = random.Random(12)
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES
    assert len(rules) > 1000
    words = sorted({t for rule in rules for t in rule.tokens}) + ["a", "index", "news", "de", "fr"]
    name = lambda: "".join(r.choice(words) + r.choice([".", "-", "", "/", "."]) for _ in range(r.randint(1, 5)))
    urls = [f"http://{name()}{r.choice(['com', 'example.org', 'net'])}/{r.choice(['fr/', 'de/', 'en/1', ''])}{name()}{r.choice(['', '?x', '.cgi', 'wp-login.php'])}" for _ in range(1500)]
    found = {x.url: x for x in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    compiled = [(rule, re.compile(rule.pattern)) for rule in rules]
    for u in urls:
        x = found[u]
        fit = [rule for rule, p in compiled if p.search(x.host + x.path)]
        best = max(fit, key=lambda rule: (rule.rank, rule.action), default=None)
        assert x.verdict == (best.action if best else "allow") and x["rule"] == (best.name if best else None)
    assert 100 < sum(x.verdict == "block" for x in found.values()) < 1400


def print_of(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    found = simhash.near_groups(docs).collect()
    assert len(found) == docs.count()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {t: print_of(t) for _, t in texts}
    distinct = sorted(set(prints.values()))
    top = {f: f for f in distinct}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 4:
                top[root(a)] = root(b)
    least = {}
    for k, t in texts:
        if k is not None:
            r = root(prints[t])
            least[r] = min(least.get(r, k), k)
    by_key = {k: t for k, t in texts}
    for r in found:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == prints[by_key[r.doc_id]] and r.component == least[root(prints[by_key[r.doc_id]])]
    assert sorted(r.component for r in found if r.doc_id is None) == [0, 4]
    assert simhash.near_groups(none).count() == 0


def test_components_of_chains(spark):
    n = 60
    fps = [((1 << 3 * i) - 1 & (1 << 64) - 1) if i < 22 else i * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for i in range(n)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, 100 - i) for i, f in enumerate(signed)], "fp long, label long")
    found = {r.fp: r.label for r in simhash.components(nodes, simhash.links(nodes, n, 4)).collect()}
    assert all(found[signed[i]] == 79 for i in range(22)) and all(found.get(signed[i], 0) in (0, 100 - i) for i in range(22, n))


def test_hot_keys_are_cut_and_lose_no_link(spark):
    rng = np.random.default_rng(11)
    top = 0x5A5A5A5A5 << 28  # all share their upper bits, and so some keys
    centres = rng.integers(0, 1 << 28, 40).tolist()
    fps = [0, -1, *(top | (centres[i % 40] ^ sum(1 << int(b) for b in rng.integers(0, 28, 3))) for i in range(900))]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in fps})
    wide = np.array(fps, np.int64).view(np.uint64)
    apart = np.bitwise_count(wide[:, None] ^ wide[None])
    label = list(range(len(fps)))
    for _ in label:
        new = [min(label[j] for j in np.flatnonzero(apart[i] <= 4)) for i in range(len(fps))]
        if new == label:
            break
        label = new
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5)
    masks = simhash.block_keys(len(fps), 4)[0]
    dealt = simhash.dealt_by(nodes.withColumnRenamed("fp", "node"), masks)
    assert simhash.spanning(dealt, 4, 50).where("u IS NULL").count() > len(fps)
    for hot in (9, 50, 1 << 12):
        edges = simhash.links(nodes, len(fps), 4, hot).collect()
        place = {x: i for i, x in enumerate(fps)}
        joined = list(range(len(fps)))

        def root(i):
            while joined[i] != i:
                joined[i] = i = joined[joined[i]]
            return i

        for e in edges:
            assert apart[place[e.u], place[e.v]] <= 4
            a, b = sorted((root(place[e.u]), root(place[e.v])))
            joined[b] = a
        assert [root(i) for i in range(len(fps))] == label, hot


def test_parts_of_keys(monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 10)
    keys = np.sort(np.r_[np.arange(20), np.full(70, 7), np.full(40, 12), np.full(6, 15)])
    for step in (1, 3, 8, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(np.arange(len(keys))[i : i + step])], ["key", "node"]) for i in range(0, len(keys), step)]
        found = list(simhash.parts_of_keys(iter(batches), 9))
        assert np.concatenate([rows[1] for rows, _ in found]).tolist() == list(range(len(keys)))
        in_parts = {k for rows, part in found if part for k in rows[0].tolist()}
        whole = [k for rows, part in found if not part for k in set(rows[0].tolist())]
        assert len(whole) == len(set(whole)) and not in_parts & set(whole)
        assert all(len(set(rows[0].tolist())) == 1 for rows, part in found if part)


def test_similar_groups(spark):
    r = random.Random(4)
    base = [prose(150, r) for _ in range(120)]
    rows, far = [(i, t) for i, t in enumerate(base)], []
    for i, t in enumerate(base):
        w = t.split(" ")
        for at in r.sample(range(len(w)), 2):  # about 0.87 of the shingles stay
            w[at] = r.choice(VOCAB)
        rows.append((1000 + i, " ".join(w)))
        for at in range(0, len(w), 8):  # under a third stays
            w[at] = r.choice(VOCAB)
        far.append((2000 + i, " ".join(w)))
    df = spark.createDataFrame([*rows, *far, (3000, None), (3001, ""), (None, "x"), (5, base[5])], "doc_id long, text string")
    found = simhash.similar_groups(df).collect()
    assert len(found) == df.count()
    own = {r.doc_id: r.component for r in found}
    assert sum(own[1000 + i] == i for i in range(120)) >= 0.9 * 120
    assert all(own[i] == i for i in range(120)) and all(own[2000 + i] == 2000 + i for i in range(120))
    assert own[3000] == own[3001] == 3000


def shingles_of(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def altered_pairs(r, n):
    """Pairs of texts, unlike all others, with words appended or a passage replaced: just above and below 0.8."""
    pairs = []
    for i in range(n):
        base = prose(150, r).split(" ")
        if i % 2:
            other = base + prose(30 + i // 2 % 9, r).split(" ")
        else:
            at = r.randrange(5, 120)
            other = [*base[:at], *prose(9 + i // 2 % 5, r).split(" "), *base[at + 9 + i // 2 % 5 :]]
        pairs.append((" ".join(base), " ".join(other)))
    return pairs


def jaccard(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return len(a & b), len(a | b)


def test_candidates_miss_no_similar_pair(spark):
    pairs = altered_pairs(random.Random(8), 200)
    texts = [t for pair in pairs for t in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for common in (simhash.common_shingles(df, "text"), simhash.common_shingles(df.limit(0), "text")):
        prints = simhash.prefixes(df, "doc_id", "text", common)
        by_node = {x.node: x.doc_id for x in prints.collect()}
        found = {tuple(sorted((by_node[x.u], by_node[x.v]))) for x in simhash.near_pairs(simhash.by_key(simhash.dealt_prefixes(prints))).where("u IS NOT NULL").collect()}
        similar = [i for i, (a, b) in enumerate(pairs) if 5 * jaccard(a, b)[0] >= 4 * jaccard(a, b)[1]]
        assert 100 < len(similar) < 200 and all((2 * i, 2 * i + 1) in found for i in similar)


def test_similar_groups_against_brute_force(spark):
    r = random.Random(9)
    texts = [t for pair in altered_pairs(r, 120) for t in pair]
    base = prose(150, r).split(" ")
    for _ in range(40):  # one cluster, of which some are linked
        at = r.randrange(0, 140)
        texts.append(" ".join([*base[:at], *prose(10, r).split(" "), *base[at + 10 :]]))
    texts += ["one two three", "one two three", "one two", "", " ", texts[0].upper()]
    sets = [shingles_of(t.lower()) for t in texts]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                a_root, b_root = sorted((root(i), root(j)))
                top[b_root] = a_root
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component for x in simhash.similar_groups(df).collect()} == {i: root(i) for i in range(len(texts))}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    good = [prose(150, r) for _ in range(60)]
    item = prose(14, r)
    rows = [(i, f"menu home\n{t}", "en", "h", 1) for i, t in enumerate(good)]
    rows += [(100, f"menu home\n{good[0]} tail", "en", "h", 1), (101, "too short", "en", "h", 1), (102, None, "en", "h", 1), (103, f"{prose(100, r)} {item} {prose(100, r)}", "en", "h", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == before
        kept.append({x.doc_id for x in docs.collect()})
    clean = set(range(60)) | {103}
    assert kept[0] == clean | {100} and kept[1] == kept[0] and kept[2] == clean and kept[3] == clean
    last = {x.doc_id: x for x in docs.collect()}
    assert "menu home" not in last[3].text and item not in last[103].text and last[103].n_chars == len(last[103].text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id for x in packed} == clean


def test_parities_rule_out_no_similar_pair(spark):
    """Bits of one set, or folded where the other's are fewer, differ in no more than the sets do."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    rows = []
    for n, m, shared in ((1000, 1100, 950), (1024, 1025, 1000), (2000, 2100, 1900), (4000, 4200, 4000), (3000, 3000, 10), (1025, 1025, 1025)):
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared : n - shared + m])
        rows.append((simhash.further_parities(a).tolist(), simhash.further_parities(b).tolist(), len(np.setxor1d(a, b))))
    assert [len(a) for a, _, _ in rows[:4]] == [0, 0, 64, 128] and len(rows[3][1]) == 256
    held = spark.createDataFrame(rows, "a array<long>, b array<long>, apart int").where("size(a) > 0 AND size(b) > 0")
    found = held.select(simhash.differing(F.col("a"), F.col("b")).alias("bits"), "apart").collect()
    assert len(found) == 4 and all(r.bits <= r.apart and (r.apart - r.bits) % 2 == 0 for r in found)
    assert found[-1].bits == 0 and found[2].bits > 6000 // 9


def test_near_dedup_links_by_fingerprints_and_by_sets(spark):
    """Documents go by links of either kind, against brute force: 4 bits of SimHash, or a similarity of 0.8."""
    import corpus_pipeline

    r = random.Random(12)
    texts = [t for pair in altered_pairs(r, 60) for t in pair]
    phrase = prose(9, r)
    texts += [" ".join([phrase] * 200 + [prose(60, r)]) for _ in range(3)]  # one fingerprint, sets unlike
    for t in [prose(300, r) for _ in range(20)]:
        texts += [t, f"{t} tail"]
    texts += [None, "", texts[0]]
    prints, sets = [print_of(t) for t in texts], [shingles_of((t or "").lower()) for t in texts]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    by_print = by_set = 0
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            alike = sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            by_print, by_set = by_print + (near and not alike), by_set + (alike and not near)
            if near or alike:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert by_print >= 3 and by_set >= 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


def test_near_dedup_of_texts_that_share_a_doc_id(spark):
    import corpus_pipeline

    r = random.Random(13)
    a, b, c = (prose(200, r) for _ in range(3))
    rows = [(3, a), (5, f"{a} tail"), (5, b), (9, f"{b} tail"), (5, c), (7, c), (None, a), (None, b)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(kept, key=str) == sorted(spark.createDataFrame([(3, a), (5, b), (5, c), (None, a), (None, b)], "doc_id long, text string").collect(), key=str)


def test_components_take_no_needless_jobs(spark, monkeypatch):
    nodes = simhash.written(spark.range(50).select(F.col("id").alias("fp"), F.col("id").alias("label")), "nodes")
    star = simhash.written(spark.range(1, 50).selectExpr("id AS u", "0L AS v").unionByName(spark.range(1, 50).selectExpr("0L AS u", "id AS v")), "star")
    made = []
    own = type(nodes).checkpoint
    monkeypatch.setattr(type(nodes), "checkpoint", lambda self, *a, **b: made.append(1) or own(self, *a, **b))
    assert {r.label for r in simhash.components(nodes, star).collect()} == {0}
    assert len(made) <= 4  # where it starts, one round, and one half that finds nothing lower
    made.clear()
    labels = simhash.numbered(nodes.select(F.col("fp").alias("node"), F.struct("label", F.col("fp").alias("node")).alias("label")))
    assert simhash.merged(labels, star.limit(0)).count() == 50 and not made
