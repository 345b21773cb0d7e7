"""Command line: fetch a page, ingest it into a corpus file, build Typst source from corpus files."""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
import urllib.request
from pathlib import Path
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright import __version__
from pagewright.functions.normalize import normalize
from pagewright.functions.text import output_name
from pagewright.operators.validate import COLOURS
from pagewright.plans import overrides, parse
from pagewright.sources import corpus, html_files, typst

AGENT = "pagewright"
TEMPLATES = Path(__file__).parent / "templates"
CODES = {"red": 31, "yellow": 33, "blue": 34}


def session() -> SparkSession:
    return SparkSession.builder.appName("pagewright").config("spark.ui.enabled", "false").getOrCreate()


def get(url: str) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html", "Accept-Language": "en"})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return answer.read()


def allows(url: str) -> bool:
    """What robots.txt says; one that can't be had allows."""
    parts = urlsplit(url)
    rules = RobotFileParser(f"{parts.scheme}://{parts.netloc}/robots.txt")
    try:
        rules.read()
    except OSError:
        return True
    return rules.can_fetch(AGENT, url)


def fetch(urls: list[str], root: Path, slug: str | None = None) -> int:
    failed = html_files.fetch(urls, str(root / "input"), get, allows, slug=slug)
    for url, fault in failed:
        print(f"{url}: {fault}", file=sys.stderr)
    return int(bool(failed))


def report(severity: str, code: str, message: str) -> None:
    line = f"[{severity}] {code}: {message}"
    print(f"\033[{CODES.get(COLOURS.get(severity, ''), 37)}m{line}\033[0m" if sys.stderr.isatty() else line, file=sys.stderr)


def ingest(slug: str, root: Path, force: bool = False) -> int:
    """input/slug.html, else fixtures/slug.html, to corpus/author/slug.md."""
    source = next((p for p in (root / "input" / f"{slug}.html", root / "fixtures" / f"{slug}.html") if p.exists()), None)
    if source is None:
        print(f"no page for {slug}", file=sys.stderr)
        return 1
    spark = session()
    pages = spark.createDataFrame([(slug, source.read_text(encoding="utf-8"), None)], "slug string, html string, source_url string")
    picked = parse.pick(parse.attempts(pages)).persist()
    for w in picked.select(F.explode("warnings").alias("w")).select("w.*").collect():
        report(w.severity, w.code, w.message)
    rendered = corpus.render(normalize(parse.documents(picked, overrides.table(spark)))).persist()
    if rendered.isEmpty():
        return 1
    if not force and any((root / r.path).exists() for r in rendered.select("path").collect()):
        print("the corpus file is there already; --force replaces it", file=sys.stderr)
        return 1
    corpus.write_files(rendered, str(root))
    return 0


def build(root: Path, slug: str | None = None, pdf: bool = False) -> int:
    """corpus/*/slug.md (all without a slug) to output/date-author-title.typ."""
    paths = sorted((root / "corpus").glob(f"*/{slug or '*'}.md"))
    if not paths:
        print("no corpus files", file=sys.stderr)
        return 1
    read = corpus.read(corpus.scan(session(), [p.as_uri() for p in paths])).persist()
    for r in read.where(F.col("error").isNotNull()).select("path", "error").collect():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    meta = lambda k: F.try_element_at(F.col("meta"), F.lit(k))
    name = output_name(meta("publication_date_slug"), meta("author_slug"), meta("title_slug"), F.regexp_extract("path", r"([^/]+)\.md$", 1))
    named = read.where(F.col("error").isNull()).select("path", name.alias("name")).join(typst.emit(read.where(F.col("error").isNull())), "path")
    files = named.select(F.concat(F.lit("output/"), "name", F.lit(".typ")).alias("path"), F.col("typst_source").alias("text")).persist()
    corpus.write_files(files, str(root))
    for name in ("default.typ", "lib/typography.typ"):
        target = root / "templates" / name
        if not target.exists():
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text((TEMPLATES / name).read_text(encoding="utf-8"), encoding="utf-8")
    failed = compile_pdf([root / r.path for r in files.select("path").collect()], root) if pdf else 0
    return int(failed or read.where(F.col("error").isNotNull()).count() > 0)


def compile_pdf(sources: list[Path], root: Path) -> int:
    """A PDF beside each source by the typst program, with the root as its project and the fonts of
    templates/fonts; how many failed."""
    program = shutil.which("typst")
    if program is None:
        print("no typst program; the .typ files are written", file=sys.stderr)
        return len(sources)
    runs = [subprocess.run([program, "compile", "--root", str(root), "--font-path", str(root / "templates" / "fonts"), str(p), str(p.with_suffix(".pdf"))], check=False) for p in sources]
    return sum(r.returncode != 0 for r in runs)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--root", type=Path, default=Path.cwd())
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("fetch")
    one.add_argument("urls", nargs="*")
    one.add_argument("--slug", help="the name of the one URL's file")
    one.add_argument("--list", type=Path, help="a file of further URLs, one a line")
    one = commands.add_parser("ingest")
    one.add_argument("slug")
    one.add_argument("--force", action="store_true")
    one = commands.add_parser("build")
    one.add_argument("slug", nargs="?")
    one.add_argument("--all", action="store_true")
    one.add_argument("--pdf", action="store_true", help="compile by the typst program, if there is one")
    got = parser.parse_args(arguments)
    if got.command == "fetch":
        urls = got.urls + ([x.strip() for x in got.list.read_text().splitlines() if x.strip() and x[0] != "#"] if got.list else [])
        if not urls or got.slug and len(urls) > 1:
            parser.error("name a URL or a list of them; --slug goes with one URL")
        return fetch(urls, got.root, got.slug)
    if got.command == "ingest":
        return ingest(got.slug, got.root, got.force)
    if not got.slug and not got.all:
        parser.error("name a slug, or --all")
    return build(got.root, None if got.all else got.slug, got.pdf)


if __name__ == "__main__":
    sys.exit(main())
