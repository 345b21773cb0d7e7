"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path, with the literal tokens that any match must
contain as whole tokens. A first pass counts the rules' tokens over all URLs, which tells which of a
rule's tokens is the rarest; the rule is filed under it. In the second pass a URL's own tokens fetch
its candidate rules, and only those run their expressions. The first pass shuffles one count for each
token and task, the second is a projection. There is no Python in either.

The index is one literal of the plan: an array of buckets by the token's CRC, so that a token is
looked up in one step and the plan has the same size for any number of rules. A bucket is a text of
entries, whose fields stand between control characters that no rule may hold.

Nulls, and URLs without ``://``, have an empty host and path; no rule can fit them and they get
``default``. URLs of any length are judged whole. Among fitting rules the highest rank decides; of equal
ranks block stands before allow, then the larger name and pattern. Repeated rows are judged one by one.
An empty table gives an empty result. Columns of other names pass through; those named host, path, rule
or verdict are replaced, unless one of them is the URL's own.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Between the buckets of an index, the entries of a bucket and the fields of an entry.
BUCKET, ENTRY, FIELD = "\x1d", "\x1e", "\x1f"


@dataclass(frozen=True)
class Rule:
    """name: reported; action: allow or block; pattern: over host + path; tokens: whole
    lower-case alphanumeric tokens of any match; rank: the highest of fitting rules decides."""

    name: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix. The longest such rule wins, and any
    of them stands above pattern rules."""
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", lowered(host + path)) if path else re.findall(r"[a-z0-9]+", lowered(host))
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    return Rule(host + path, action, pattern, tuple(dict.fromkeys(whole)), 1_000_000 + len(host + path))


def lowered(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


#: The rules that the production query applies.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: Words that are enough in a host's or path's part, and, by family, nouns and the words that make a
#: bad name of them, before or after, with a hyphen or without.
BAD_WORDS = ("casino", "poker", "betting", "roulette", "jackpot", "sportsbook", "baccarat", "blackjack", "viagra", "cialis", "porn", "xxx", "warez", "keygen")
FAMILIES = (
    (("bets", "bet", "casino", "slots", "poker", "bingo", "lottery", "lotto", "wager", "odds", "roulette", "jackpot"), ("free", "best", "online", "win", "big", "live", "real", "top", "play", "lucky", "royal", "vip", "mega", "bonus")),
    (("pills", "meds", "tablets", "steroids", "viagra", "cialis", "pharmacy", "drugs"), ("cheap", "buy", "order", "online", "discount", "generic", "fast", "best")),
    (("adult", "porn", "sex", "nude", "escort", "xxx", "cams"), ("x", "tube", "video", "videos", "chat", "dating", "pics", "movies", "hub", "live", "zone", "free")),
    (("ads", "ad", "click", "banner", "popup", "pixel"), ("track", "tracker", "tracking", "server", "serve", "network", "sync", "counter", "delivery", "redirect")),
    (("spam", "link", "seo", "backlink", "article", "doorway"), ("farm", "spam", "wheel", "exchange", "spinner")),
    (("payday", "loan", "loans", "debt"), ("fast", "instant", "cash", "quick", "easy")),
    (("crack", "cracked", "keygen", "serial", "nulled", "warez"), ("download", "free", "full", "keys", "zone")),
)


def word_rule(*words: str, joined: bool = False) -> Rule:
    """Blocks names with these words in a row, as a whole part between dots, hyphens and slashes."""
    name = ("" if joined else "-").join(words)
    return Rule(None, "block", rf"(?:^|[.\-]){name}(?:[.\-]|/|$)", (name,) if joined else words, 10)


def family_rules() -> tuple[Rule, ...]:
    found = [word_rule(w) for w in BAD_WORDS]
    for nouns, others in FAMILIES:
        for pair in ((x, y) for n in nouns for o in others for x, y in ((o, n), (n, o))):
            found += [word_rule(*pair), word_rule(*pair, joined=True)]
    return tuple(dict.fromkeys(found))


PATTERN_RULES = (
    *family_rules(),
    Rule(None, "block", r"/wp-login\.php$", ("wp", "login", "php"), 5),
    Rule(None, "block", r"/xmlrpc\.php$", ("xmlrpc", "php"), 5),
    Rule(None, "block", r"/cgi-bin/.*\.cgi$", ("cgi", "bin"), 5),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?,
    # or the end. Both are empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("`_url`"))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and the distinct tokens of both to the rows."""
    host, path = host_path(F.col("_url"))
    return (
        pages.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
        .withColumns({"host": host, "path": path})
        .withColumn("_tokens", F.array_distinct(F.split(lower_ascii(F.concat("host", "path")), "[^a-z0-9]+")))
        .drop("_url")
    )


def token_counts(rows: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of these tokens stands. At most one row a token comes back."""
    wanted = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(FIELD.join(tokens)), FIELD, -1)).alias("token"))
    # The other side is as large as the rules, which the plan holds anyway.
    found = rows.select(F.explode("_tokens").alias("token")).join(F.broadcast(wanted), "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in found}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """token -> rules whose rarest token it is (ties: the first by name)."""
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"no literal token: {rule}")
        filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return filed


def buckets(filed: dict[str, list[Rule]]) -> tuple[str, int]:
    """The index as a text, and its number of buckets."""
    n = 1
    while n < 2 * len(filed):
        n *= 2
    held: list[list[str]] = [[] for _ in range(n)]
    for token, rules in sorted(filed.items()):
        for r in rules:
            fields = [token, f"{r.rank:012d}", r.action, "" if r.name is None else "=" + r.name, r.pattern]
            if any(mark in x for x in fields for mark in (BUCKET, ENTRY, FIELD)):
                raise ValueError(f"a control character that separates rules: {r}")
            held[zlib.crc32(token.encode()) % n].append(FIELD.join(fields))
    return BUCKET.join(ENTRY.join(x) for x in held), n


def judge(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the rows of pages."""
    rows = parsed(pages.drop(*({"host", "path", "rule", "verdict", "_tokens", "_url", "_best"} - {url})), url)
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).drop("_tokens")
    text, n = buckets(index(rules, token_counts(rows, sorted({t for r in rules for t in r.tokens}))))
    table = F.split(F.lit(text), BUCKET, -1)  # folded to one literal
    field = lambda e, k: F.element_at(F.split(e, FIELD, -1), k)

    def candidates(token: Column) -> Column:
        entries = F.split(F.element_at(table, (F.crc32(token) % n + 1).cast("int")), ENTRY, -1)
        return F.filter(entries, lambda e: F.startswith(e, F.concat(token, F.lit(FIELD))))

    subject = F.concat("host", "path")
    fitting = F.filter(F.flatten(F.transform("_tokens", candidates)), lambda e: F.rlike(subject, field(e, 5)))
    # Without the token an entry sorts by rank, action, name and pattern.
    best = F.array_max(F.transform(fitting, lambda e: F.substring_index(e, FIELD, -4)))
    name = field(F.col("_best"), 3)
    return (
        rows.withColumn("_best", best)
        .withColumns({"rule": F.when(name != "", F.substr(name, F.lit(2))), "verdict": F.coalesce(field(F.col("_best"), 2), F.lit(default))})
        .drop("_best", "_tokens")
    )
