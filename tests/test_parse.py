import datetime

import pytest
import sample
from pyspark.sql import functions as F

from pagewright.functions.normalize import normalize
from pagewright.operators import html_tokens, validate
from pagewright.plans import anonymise, overrides, parse, views
from pagewright.plans import strategy as st
from pagewright.sources import corpus, html_files, typst

SCHEMA = "slug string, html string, source_url string"


def paragraphs(html, **kw):
    return html_tokens.paragraphs(html, "vaticanrichtext", "div", kw.get("reopen", True))


def test_inline_markup():
    def md(inner):
        return paragraphs(f"<p>{inner}</p>")[0]["md"]

    assert md('a<a href="http://x.y/d.html#_ftn12" name="_ftnref12">[12]</a>.') == "a[^12]."
    assert md('<a href="#_ftnref3" name="_ftn3">[3]</a> Note') == "[3] Note"
    assert md("<i>Corpus </i>VI <b> bold</b>") == "*Corpus* VI **bold**"
    assert md('<a href="http://a.b">at</a><a href="x"></a>') == "[at](http://a.b)"
    assert md("one<br>two &amp;amp; inter- national") == "one two & international"
    assert md("<i> </i>x") == "x"


def test_recovery():
    rows = paragraphs('<div class="vaticanrichtext"><p>1. a<p><b>head<p>next<script>var t="</p>"</script></div>')
    assert [r["text_raw"] for r in rows][:2] == ["1. a", "head"] and len(rows) == 3
    assert rows[1]["has_own_text"] is False and rows[2]["md"] == "**next**"
    assert paragraphs("<p><b>head<p>next", reopen=False)[1]["md"] == "next"
    assert paragraphs("") == []


@pytest.fixture(scope="module")
def attempts(spark):
    pages = spark.createDataFrame(
        [
            ("good", sample.page(), None),
            ("none", "<p>nothing", None),
            ("null", None, None),
            ("undated", sample.page(date="no date"), "http://given"),
            ("veritatis-splendor", sample.page(), "http://given"),
        ],
        SCHEMA,
    )
    return parse.attempts(pages).persist()


def test_attempts(attempts):
    rows = {(r.slug, r.strategy_ord): r for r in attempts.collect()}
    assert sorted(rows) == [("good", 0), ("none", 0), ("none", 1), ("null", 0), ("null", 1), ("undated", 0), ("undated", 1), ("veritatis-splendor", 0)]
    assert rows["good", 0].warnings == []
    assert [(w.code, w.message) for w in rows["none", 1].warnings] == [("strategy-crashed", "permissive: body container not found")]
    assert rows["undated", 0].warnings[0].message == "default: could not extract promulgation date from body"


def test_document(attempts):
    d = attempts.where("slug = 'good'").first().document
    assert (d.title, d.subtitle, d.pope, d.salutation, d.incipit) == ("Spes Nova", "On a New Hope", "Benedict XVI", "To the Bishops, Priests and Deacons", "Spes Nova")
    assert d.promulgated == datetime.date(2001, 3, 25) and d.author_slug == "benedict-xvi" and d.source_url == "https://x.example/doc.html"
    assert [(p.number, p.chapter, p.section) for p in d.paragraphs] == [
        (1, None, "Introduction"),
        (None, None, "Introduction"),
        (2, None, "Introduction"),
        (3, "I. The Way Of The World", None),
        (4, "I. The Way Of The World", "A section"),
        (5, "II. Second part", None),
        (None, None, None),
        (None, None, None),
    ]
    assert d.paragraphs[0].text == "*Spes nova*, a first word[^1] of the text." and d.paragraphs[-1].text == "**BENEDICTUS PP. XVI**"
    assert [tuple(f) for f in d.footnotes] == [(1, "Note 1 text."), (2, "Note 2 text."), (3, "Third note.")]


def test_pick_and_overrides(spark, attempts):
    picked = parse.pick(attempts)
    assert {r.slug: r.strategy_ord for r in picked.collect()} == {"good": 0, "none": 1, "null": 1, "undated": 1, "veritatis-splendor": 0}
    docs = {r.title_slug: r for r in parse.documents(picked, overrides.table(spark)).collect()}
    assert docs["veritatis-splendor"].pope == "John Paul II" and docs["veritatis-splendor"].author_slug == "john-paul-ii"
    assert docs["veritatis-splendor"].source_url == "http://given" and docs["good"].pope == "Benedict XVI"
    with pytest.raises(ValueError):
        overrides.register("x", overrides.DocConfig(overrides={"nonsense": 1}))


def test_strategies():
    own = st.DEFAULT.replace(name="own")
    assert own.split_notes is st.DEFAULT.split_notes and st.get("permissive") is st.PERMISSIVE
    with pytest.raises(AttributeError):
        own.name = "x"
    with pytest.raises(KeyError):
        st.get("unknown")
    st.register(own)
    assert st.get("own") is own


def test_every_part_of_a_strategy_is_used(spark):
    pages = spark.createDataFrame([("a", sample.page(), None)], SCHEMA)
    own = {
        "title_block": lambda lines: F.struct(F.lit("Own").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.lit("Some One").alias("pope"), F.lit("").alias("salutation")),
        "find_title": lambda rows, key: rows.withColumn("title_pos", F.lit(1)),
        "split_notes": lambda rows, key: rows.withColumns({"is_body": F.col("inside"), "is_note": F.lit(False)}),
        "find_body": lambda rows, key: rows.withColumns({"body": F.lit(None).cast("int"), "inside": F.lit(False)}),
        "drop_preamble": lambda rows, key: rows.withColumn("start", F.lit(6)),
        "is_heading": lambda own_text: F.lit(False),
        "chapter_numeral": lambda text: F.lit(None).cast("string"),
        "is_dateline": lambda text: F.lit(False),
        "is_signature": lambda text: F.lit(False),
    }
    usual = parse.pick(parse.attempts(pages, strategy=st.DEFAULT)).first().asDict(True)
    for name, part in own.items():
        found = parse.pick(parse.attempts(pages, strategy=st.DEFAULT.replace(name="own", **{name: part}))).first().asDict(True)
        assert found["document"] != usual["document"], name
    document = parse.parse(pages, strategy=st.DEFAULT.replace(name="own", title_block=own["title_block"])).first()
    assert (document.title, document.author_slug) == ("Own", "some-one")
    parse.release()


def test_failures_are_reported(spark, attempts):
    picked = parse.pick(attempts)
    assert {r.slug: r.message for r in parse.failures(picked).collect()}["none"] == "permissive: body container not found"
    with pytest.raises(Exception, match="no strategy could read the page"):
        parse.documents(picked, strict=True).collect()
    with pytest.warns(parse.ParseWarning, match="strategy-crashed"):
        parse.warn(attempts)


def test_deep_pages():
    deep = 5000
    row = paragraphs('<div class="vaticanrichtext">' + "<span>" * deep + "<p>" + "<i>" * deep + "x" + "</i>" * deep + "</p>")[0]
    assert row["text_raw"] == "x" and row["lines"] == ["x"] and row["md"].strip("*") == "x"


def test_corpus_and_typst(spark, attempts):
    docs = parse.documents(parse.pick(attempts)).where("title_slug = 'good'")
    text = corpus.render(normalize(docs)).first().text
    assert text.startswith("---\ntitle_slug: good\n") and "\n::: {.paragraph n=1}\n*Spes nova*" in text and "## A section\n\n" in text and text.endswith("[^3]: Third note.\n\n")
    files = spark.createDataFrame([("p", text), ("bad", "no frontmatter"), ("open", "---\nx: 1\n")], "path string, raw string")
    read = corpus.read(files).persist()
    rows = {r.path: r for r in read.collect()}
    assert rows["bad"].error == "corpus file missing YAML frontmatter" and rows["open"].error == "corpus frontmatter is not terminated"
    assert rows["p"].meta["title"] == "Spes Nova" and rows["p"].footnotes == {1: "Note 1 text.", 2: "Note 2 text.", 3: "Third note."}
    assert [(b.kind, b.number, b.numeral) for b in rows["p"].blocks] == [
        ("salutation", None, None),
        ("section", None, None),
        ("paragraph", 1, None),
        ("continuation", None, None),
        ("paragraph", 2, None),
        ("chapter-divider", None, "I"),
        ("paragraph", 3, None),
        ("section", None, None),
        ("paragraph", 4, None),
        ("chapter-divider", None, "II"),
        ("paragraph", 5, None),
        ("dateline", None, None),
        ("signature", None, None),
    ]
    source = typst.emit(read.where("path = 'p'"), F.lit("2020-01-02").cast("date")).first().typst_source
    assert '#chapter-divider("I.", "The Way Of The World")' in source and "#signature([BENEDICTUS PP. XVI])" in source
    assert "promulgated: datetime(year: 2001, month: 3, day: 25)," in source and "#paragraph-num(2) Second, see#footnote[Note 2 text.]." in source


def test_reader_quirks(spark):
    body = "::: {.paragraph n=3}\na\n\n## b\n:::\nplain\nmore\n## H\nunder\n::: {.unknown}\n\n::: {.dateline}\nlost"
    rows = corpus.blocks(spark.createDataFrame([("p", body)], "path string, body string"), ["path"]).orderBy("block_pos").collect()
    assert [(r.kind, r.text, r.number) for r in rows] == [("paragraph", "a  ## b", 3), ("continuation", "plain more", None), ("section", "H", None), ("continuation", "under ::: {.unknown}", None)]


def test_typst_follows_chains_of_notes():
    notes = {n: f"note {n} [^{n + 1}]" for n in range(1, 3000)} | {3000: "end", 4000: "a [^4001]", 4001: "b [^4000](c)"}
    found = typst.markup("x[^1]", notes)
    assert found.startswith("x#footnote[note 1 #footnote[note 2 ") and found.endswith("#footnote[end" + "]" * 3000) and "missing" not in found
    once = "#footnote[a #footnote[b #footnote[\\[footnote 4000 missing from corpus\\]]\u200b(c)]]"
    assert typst.markup("[^4000] [^4000]", notes) == f"{once} {once}"


def test_typst_inline():
    notes = {1: "see [^2]", 2: "end", 3: "again [^3]"}
    assert typst.markup("a*b*(c) [^1] [^9] #x", notes) == "a#emph[b]​(c) #footnote[see #footnote[end]] #footnote[\\[footnote 9 missing from corpus\\]] \\#x"
    assert typst.markup("[^3]", notes).count("#footnote") == 2
    assert typst.opening("One two three four five") == "#smallcaps[#lower[One two three four]] five"
    assert typst.opening("#emph[x]") == "#emph[x]" or "#smallcaps" in typst.opening("#emph[x]")


def test_validation(spark):
    p = "array<struct<number:int,text:string>>"
    rows = spark.createDataFrame(
        [
            ("ok", "T", "P", [(1, "x[^1]")], [(1, "n")]),
            ("gap", "T", "P", [(5, "x"), (7, "y"), (7, "z")], []),
            ("refs", " ", "", [(1, "a[^1][^2]")], [(2, "n"), (3, "m")]),
            ("none", "T", "P", [], []),
            ("plain", "T", "P", [(None, "a[^1]")], []),
        ],
        f"k string, title string, pope string, paragraphs {p}, footnotes {p}",
    ).withColumn("promulgated", F.lit("2001-01-01").cast("date"))
    d = F.struct("title", "pope", "promulgated", "paragraphs", "footnotes")
    found = {r.k: [str(x) for x in r.w] for r in rows.select("k", F.transform(validate.checks(d), validate.shown).alias("w")).collect()}
    assert found["ok"] == []
    assert found["gap"] == ["[warn] first-paragraph-not-1: first numbered paragraph is 5, expected 1", "[warn] paragraph-number-gap: paragraph numbers are non-contiguous: 5→7, 7→7"]
    assert found["refs"] == ["[error] missing-title: title is empty", "[error] missing-pope: pope is empty", "[warn] footnote-mismatch: refs without defs: [1]; defs without refs: [3]"]
    assert found["none"] == ["[error] no-paragraphs: no body paragraphs extracted"]
    assert [x.split(":")[0] for x in found["plain"]] == ["[error] no-numbered-paragraphs", "[error] no-footnote-definitions"]


def test_views_and_stand_ins(spark, attempts):
    views.register(parse.documents(parse.pick(attempts)), attempts, "t_")
    assert spark.sql("SELECT count(*) FROM t_paragraphs WHERE title_slug = 'good' AND number IS NOT NULL").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM t_warnings WHERE severity = 'error'").first()[0] == 6
    tokens = html_tokens.tokens(spark.createDataFrame([("a", sample.page())], "slug string, html string"), "slug")
    rows = {r.text_stripped[:8]: r for r in anonymise.anonymise(tokens).collect()}
    assert rows["2. Secon"].part == "numbered" and rows["2. Secon"].stand_in.startswith("2. ") and rows["Introduc"].part == "heading"


def test_sources(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    assert html_files.fetch(["http://x/one.html", "http://x/two.html"], str(a), lambda u: u.encode(), lambda u: "two" not in u, 0) == [("http://x/two.html", "robots.txt disallows http://x/two.html")]
    assert html_files.fetch(["http://x/a/hf_some-one_enc_01012001_nova-spes.html?x=/y"], str(tmp_path / "c"), lambda u: b"", lambda u: True, 0) == []
    assert html_files.fetch(["http://x/a"], str(tmp_path / "c"), lambda u: b"", lambda u: True, 0, "own") == []
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["nova-spes.html", "own.html"]
    urls = ["http://x/12-enciclica-a.htm", "x/y/7-b.html#z", "http://x", "http://x/", "a?b", "", "papa-francesco_20_enciclica-c.html"]
    rows = html_files.slugs(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {r.url: html_files.slug_of(r.url) for r in rows} == {r.url: r.slug for r in rows}
    b.mkdir()
    (b / "one.html").write_text("fixture")
    (b / "three.html").write_text("fix\nture")
    rows = html_files.preferred(html_files.scan(spark, str(a)), html_files.scan(spark, str(b)))
    assert {r.slug: r.html for r in rows.collect()} == {"one": "http://x/one.html", "three": "fix\nture"}


def test_stream(spark, tmp_path):
    from pagewright.streaming import html_folder

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "doc.html").write_text(sample.page())
    html_folder.start(html_folder.source(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Spes Nova"]


def test_attempt_reads_tokens_once(spark):
    """Once for the body containers, once for the rows, once for faults: each read walks all windows."""
    pages = spark.createDataFrame([("good", sample.page(), None)], SCHEMA)
    found = parse.attempt(pages, html_tokens.tokens(pages, "slug"), st.DEFAULT)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3


def test_settings_shuffle_no_documents(spark):
    docs = spark.range(9).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("title_slug"), F.lit("a").alias("author_slug"), F.lit("p").alias("pope"))
    plan = overrides.apply(docs, overrides.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "LocalTableScan" in plan


def test_plain_tags(monkeypatch):
    """Tags that skip the parser's search for attributes give the same rows."""
    pages = [sample.page(), "<DIV class=vaticanrichtext><P>a<BR>b<script><p></script></P ><p>c</b></p><hr/><p><i>d</DIV>", "<title><p></title><p>x</p><style></p></style></p>"]
    with_all = [paragraphs(x) for x in pages]
    searched = []
    found = html_tokens.HTMLParser.parse_starttag
    monkeypatch.setattr(html_tokens.HTMLParser, "parse_starttag", lambda self, i: searched.append(i) or found(self, i))
    assert paragraphs("<p><b>x</b></p>")[0]["md"] == "**x**" and not searched
    monkeypatch.setattr(html_tokens, "PLAIN", frozenset())
    assert [paragraphs(x) for x in pages] == with_all and searched


def test_frontmatter_fields(monkeypatch):
    """Plain values skip YAML's emitter and are written as it writes them."""
    import yaml

    plain = ["Leo XIV", "http://a.b/c?d=e&f=%20", "2001-05-03", "spes-1"]
    other = ["yes", "Null", "a: b", "x #y", "", None, "word " * 30 + "end", "«q»", "- a", "1:30", "a  b"]
    expected = [yaml.safe_dump({"pope": v}, sort_keys=False, allow_unicode=True) for v in plain + other]
    assert [corpus.field("pope", v) for v in plain + other] == expected
    monkeypatch.setattr(yaml, "safe_dump", None)
    assert [corpus.field("pope", v) for v in plain] == expected[: len(plain)]


def test_changes_sort_once(spark):
    rows = spark.createDataFrame([("a", i, c, s) for i, (c, s) in enumerate([(None, "s"), ("C", "s"), ("C", None), (None, "s"), ("C", "t"), ("D", None), ("D", "t"), ("D", "t")])], "k string, pos int, chapter string, section string")
    found = corpus.changes(rows, ["k"])
    assert [(r.new_chapter, r.new_section) for r in found.orderBy("pos").collect()] == [(False, True), (True, True), (False, False), (False, False), (False, True), (True, False), (False, True), (False, False)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
