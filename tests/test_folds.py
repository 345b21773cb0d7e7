"""The windows against sequential readers written for the test."""

import random

from pyspark.sql import functions as F

from pagewright.operators import fold
from pagewright.sources import corpus

KINDS = ("num", "preamble", "roman", "headnum", "head", "prose")


def read_in_turn(rows):
    """rows: (pos, kind). The state is what a reader would remember."""
    chapter = section = pending = number = None
    titles, out = [], []

    def close():
        nonlocal chapter, section, pending
        if pending:
            chapter, section, pending = " ".join(["IV.", *titles]), None, None
            titles.clear()

    for pos, kind in rows:
        if kind in ("num", "prose"):
            close()
            out.append((pos, pos if kind == "num" else number, chapter, section))
            number = None
        elif kind == "preamble":
            close()
            pending = True
        elif pending:
            titles.append(f"Heading {pos}")
        elif kind == "roman":
            chapter, section = f"II. Part {pos}", None
        elif kind == "headnum":
            number, section = pos, f"Heading {pos}"
        else:
            section = f"Heading {pos}"
    return out


def test_body_fold(spark):
    rng = random.Random(2)
    docs = {d: [(p, rng.choice(KINDS)) for p in range(rng.randint(1, 25))] for d in range(400)}
    rows = spark.createDataFrame([(d, p, k) for d, held in docs.items() for p, k in held], "doc int, pos int, kind string")
    text = F.concat(F.lit("Heading "), F.col("pos").cast("string"))
    rows = rows.withColumns({"heading": text, "numeral": F.lit("IV"), "roman_title": F.concat(F.lit("II. Part "), F.col("pos").cast("string")), "head_number": F.col("pos"), "own_number": F.when(F.col("kind") == "num", F.col("pos")), "md": F.lit("x")})
    found = {}
    for r in fold.carry(rows, ["doc"]).orderBy("doc", "pos").collect():
        found.setdefault(r.doc, []).append((r.pos, r.number, r.chapter, r.section))
    for d, held in docs.items():
        assert found.get(d, []) == read_in_turn(held), held


LINES = ("::: {.paragraph n=2}", "::: {.salutation}", "::: {.chapter-divider numeral=IV}", ":::", "## A", "", "text", "more  ", "::: {.other}")


def blocks_in_turn(lines):
    out, fence, inside, plain = [], None, [], []

    def end_plain():
        if plain:
            out.append(("continuation", " ".join(plain), None, None))
            plain.clear()

    for line in map(str.rstrip, lines):
        if fence:
            if line == ":::":
                kind, number, numeral = fence
                out.append((kind, " ".join(inside).strip(), number, numeral))
                fence, inside = None, []
            else:
                inside.append(line)
        elif line in LINES[:3]:
            end_plain()
            fence = (("paragraph", 2, None), ("salutation", None, None), ("chapter-divider", None, "IV"))[LINES.index(line)]
        elif line.startswith("## "):
            end_plain()
            out.append(("section", line[3:], None, None))
        elif not line:
            end_plain()
        else:
            plain.append(line)
    end_plain()
    return out


def test_block_fold(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice(LINES) for _ in range(rng.randint(1, 20))] for d in range(400)}
    files = spark.createDataFrame([(d, "\n".join(held)) for d, held in docs.items()], "doc int, body string")
    found = {}
    for r in corpus.blocks(files, ["doc"]).orderBy("doc", "block_pos").collect():
        found.setdefault(r.doc, []).append((r.kind, r.text, r.number, r.numeral))
    for d, held in docs.items():
        assert found.get(d, []) == blocks_in_turn(held), held
