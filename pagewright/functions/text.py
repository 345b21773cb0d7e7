"""Column functions on text: slugs, markup, numbers, headings, title blocks, signatures, dates.

All of them are built-in expressions. Patterns are Java's, with (?U) where letters, digits or white
space outside ASCII count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and formats of the document layouts that are recognised.
SMALL_WORDS = (
    "and", "or", "of", "the", "to", "in", "for", "on", "a", "an",
    "at", "by", "as", "with", "from",
    "et", "de", "ad", "ex", "per", "pro", "sub", "cum",
)
CHAPTER_WORDS = {
    "ONE": "I", "TWO": "II", "THREE": "III", "FOUR": "IV", "FIVE": "V",
    "SIX": "VI", "SEVEN": "VII", "EIGHT": "VIII", "NINE": "IX", "TEN": "X",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
    "twenty-first", "twenty-second", "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh", "twenty-eighth", "twenty-ninth", "thirtieth", "thirty-first",
)
SLUG_PATTERNS = (r"^hf_[a-z-]+_enc_\d+_(.+)$", r"^papa-francesco_\d+_enciclica-(.+)$", r"^\d+-enciclica-(.+)$", r"^\d+-(.+)$")
RUBRIC = "ENCYCLICAL LETTER"
RUBRIC_STARTS = ("OF THE SUPREME PONTIFF", "OF HIS HOLINESS", "OF THE HOLY FATHER")
RUBRIC_LINES = ("HOLY FATHER", "SUPREME PONTIFF")
NUMBERED = r"""(?U)^\s*\*{0,2}\s*(\d{1,4})\.\*{0,2}\s*(?=[A-Za-z“”"‘’'(\[*])"""
ROMAN_HEADING = r"^([IVXLCDM]+)\.\s+(.+)$"
NAMED = r"^[A-Z][A-Za-z'’]*(?:\s+[A-Z][A-Za-z'’]*)?\s+(?:PP\.\s+)?[IVXLCDM]+$"
QUOTED_TITLE = r"(?U)^[«‹]\s*(.+?)\s*[»›]$"
MONTH = "|".join(MONTHS)
BY_ORDINAL = rf"\bthe\s+([a-z-]+?)(?:\s+day)?\s+of\s+({MONTH})\b.*?(\d{{4}})"
BY_DAY = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?({MONTH})\b.*?(\d{{4}})"
BY_MONTH = rf"\b({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b.*?(\d{{4}})"
URL_PATTERNS = (r'(?i)<link\b[^>]*rel="canonical"[^>]*href="([^"]+)"', r'(?i)<link\b[^>]*href="([^"]+)"[^>]*rel="canonical"', r'(?i)<meta\b[^>]*property="og:url"[^>]*content="([^"]+)"')
SIGNATURE_LENGTH, SIGNATURE_RATIO, TITLE_LENGTH = 60, 0.7, 400

#: White space as Python strips it.
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def folded(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


# ---- slugs ----


def slugify(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 to a hyphen, no hyphen at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def url_path(url: Column) -> Column:
    """The path of a URL, or the whole input if it has none; never fails."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", url).otherwise(path)


def derive_slug(url: Column) -> Column:
    """The document's slug from the last part of a URL's path."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(url_path(url), r"([^/]*)$", 1), r"\.html$", ""), r"\.htm$", "")
    return F.coalesce(*(matched(stem, p) for p in SLUG_PATTERNS), stem)


def output_name(date: Column, author: Column, title: Column, stem: Column) -> Column:
    """date-author-title without empty parts; the stem stands in for a missing title."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("-", filled(date), filled(author), F.coalesce(filled(title), stem))


# ---- inline markup ----


def strip_markup(text: Column) -> Column:
    return strip(F.replace(text, F.lit("*"), F.lit("")))


def clean_heading(text: Column) -> Column:
    """Links to their labels, footnote marks and asterisks gone."""
    return strip(folded(folded(F.regexp_replace(text, r"\[([^\]]+)\]\([^)\s]+\)", "$1"), r"\[\^\d+\]"), r"\*"))


def paragraph_number(text: Column) -> Column:
    """The number that a paragraph starts with, else null."""
    return F.regexp_extract(text, NUMBERED, 1).try_cast("int")


def paragraph_rest(text: Column) -> Column:
    """The text after the paragraph's number; all of it without one."""
    return F.when(F.rlike(text, F.lit(NUMBERED)), strip(F.regexp_replace(text, NUMBERED, ""))).otherwise(text)


# ---- casing ----


def is_roman(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^[IVXLCDM]+\.?$"))


def capitalize_first_letter(word: Column) -> Column:
    """The first letter upper-cased, whatever stands before it."""
    before = F.length(F.regexp_extract(word, r"^(\P{L}*)", 1))
    return F.concat(F.substring(word, F.lit(1), before), F.upper(F.substring(word, before + 1, F.lit(1))), F.substring(word, before + 2, F.length(word)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){BLANK}+"), lambda w: w != "")


def title_case(text: Column) -> Column:
    """Roman numerals stay, small words in the interior are lower, other words are capitalised."""

    def cased(words: Column) -> Column:
        def one(word: Column, at: Column) -> Column:
            small = (at > 0) & (at < F.size(words) - 1) & F.lower(folded(word, r"\P{L}")).isin(*SMALL_WORDS)
            return F.when(is_roman(word), word).when(small, F.lower(word)).otherwise(let(F.lower(word), capitalize_first_letter))

        return F.array_join(F.transform(words, one), " ")

    return let(words_of(text), cased)


# ---- headings ----


def chapter_numeral(text: Column) -> Column:
    """Of a CHAPTER or PART heading: words to Roman, Roman and digits as they are, else null."""
    word = matched(strip(text), r"(?i)^(?:CHAPTER|PART) \s*(\S+?)[.:]*$")
    upper = F.upper(word)
    spelt = F.try_element_at(F.create_map(*(F.lit(x) for pair in CHAPTER_WORDS.items() for x in pair)), upper)
    return F.coalesce(spelt, F.when(F.rlike(upper, F.lit(r"^[IVXLCDM]+$|^\d+$")), upper))


def roman_heading(text: Column) -> Column:
    """'IV. Title' without periods at its end, else null."""
    title = F.regexp_replace(strip(F.regexp_extract(text, ROMAN_HEADING, 2)), r"\.+$", "")
    return F.when(F.rlike(text, F.lit(ROMAN_HEADING)), F.concat_ws(" ", F.concat(F.regexp_extract(text, ROMAN_HEADING, 1), F.lit(".")), F.nullif(title, F.lit(""))))


# ---- signatures ----


def upper_ratio(text: Column) -> Column:
    """Upper-case letters to letters; null without letters."""
    letters = F.length(folded(text, r"\P{L}"))
    return F.length(folded(text, r"\P{Lu}")) / F.nullif(letters, F.lit(0))


def is_signature(text: Column) -> Column:
    """A short line, mostly in capitals."""
    plain = strip_markup(text)
    return F.coalesce((F.length(plain) <= SIGNATURE_LENGTH) & (upper_ratio(plain) > SIGNATURE_RATIO), F.lit(False))


def is_written_signature(text: Column) -> Column:
    """The writer's test, which strips outer asterisks alone."""
    plain = strip(F.regexp_replace(strip(text), r"^\*+|\*+$", ""))
    return F.coalesce((F.length(plain) <= SIGNATURE_LENGTH) & (upper_ratio(plain) > SIGNATURE_RATIO), F.lit(False))


# ---- dates ----

def dateline_date(text: Column) -> Column:
    """The date in a dateline: ordinal words, day and month, or month and day, in this order; the
    year is the next run of four digits. Null if there is none or the day doesn't exist."""
    months = F.array(*(F.lit(m.lower()) for m in MONTHS))
    ordinals = F.array(*map(F.lit, ORDINALS))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def form(plain: Column, pattern: str, day: int, month: int, spelt: bool = False) -> Column:
        """[year, month, day] as strings; null if the pattern or its ordinal isn't there."""
        flags = "(?iUd)" + pattern
        part = lambda g: F.regexp_extract(plain, flags, g)
        number = F.nullif(F.array_position(ordinals, F.lower(part(day))), F.lit(0)) if spelt else part(day).try_cast("long")
        return let(number, lambda n: F.when(n.isNotNull(), F.array(part(3), two(F.array_position(months, F.lower(part(month)))), two(n))))

    def found(plain: Column) -> Column:
        return F.coalesce(
            form(plain, BY_ORDINAL, 1, 2, True),
            form(plain, BY_DAY, 1, 2),
            form(plain, BY_MONTH, 2, 1),
        )

    return let(let(F.replace(text, F.lit("*"), F.lit("")), found), lambda ymd: F.try_to_date(F.array_join(ymd, "-"), "yyyy-MM-dd"))


def roman(number: Column) -> Column:
    """A number from 1 to 3999 in Roman numerals."""
    rows = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
    digit = lambda unit: (F.floor(number / unit) % 10).cast("int") + 1
    return F.when(number.between(1, 3999), F.concat(*(F.element_at(F.array(*map(F.lit, row)), digit(unit)) for row, unit in zip(rows, (1000, 100, 10, 1)))))


# ---- title blocks ----

def unpope(text: Column) -> Column:
    return F.regexp_replace(text, r"(?iU)^pope\s+", "")


def is_rubric_line(text: Column) -> Column:
    return let(F.upper(text), lambda u: (u == RUBRIC) | u.isin(*RUBRIC_LINES) | F.rlike(u, F.lit("^(?:" + "|".join(RUBRIC_STARTS) + ")")))


def title_block(lines: Column) -> Column:
    """struct(title, subtitle, pope, salutation) of a title paragraph's lines."""

    def slots(bare: Column) -> Column:
        return let(F.transform(bare, lambda x: F.rlike(unpope(x), F.lit(NAMED))), lambda named: named_slots(bare, F.array_position(named, F.lit(True))))

    def named_slots(bare: Column, at: Column) -> Column:
        """at: the place of the line with the author's name, 0 without one."""
        other = F.filter(bare, lambda x, i: (i + 1 != at) & (x != ""))
        return let(other, lambda o: let(F.slice(o, F.when(at > 0, 2).otherwise(3), F.size(o) + 1), lambda rest: struct_of(bare, at, o, rest)))

    def struct_of(bare: Column, at: Column, other: Column, rest: Column) -> Column:
        item = lambda a, k: F.try_element_at(a, F.lit(k))
        name = F.when(at > 0, F.try_element_at(bare, at.cast("int"))).otherwise(item(other, 2))
        greeted = F.exists(rest, lambda x: F.startswith(F.upper(x), F.lit("TO ")))
        subtitle = F.when(F.size(rest) > 0, title_case(F.when(greeted, item(rest, -1)).otherwise(F.array_join(rest, " "))))
        greeting = F.when(greeted, F.array_join(F.transform(F.slice(rest, F.lit(1), F.size(rest) - 1), title_case), ", ")).otherwise("")
        return F.struct(
            title_case(F.coalesce(item(other, 1), F.lit(""))).alias("title"),
            subtitle.alias("subtitle"),
            title_case(F.coalesce(unpope(name), F.lit(""))).alias("pope"),
            greeting.alias("salutation"),
        )

    kept = F.filter(F.transform(lines, strip_markup), lambda x: ~is_rubric_line(x))
    return let(F.transform(kept, lambda x: F.coalesce(matched(x, QUOTED_TITLE), x)), slots)


def incipit(first_paragraph: Column, title: Column) -> Column:
    """The first italic span of paragraph 1 that has the title's first word, in title case; the
    title if there is none, or if a single word echoes a longer title."""
    plain = lambda s: F.transform(words_of(F.lower(s)), lambda w: F.regexp_replace(w, r"""^[".,'’‘“”]+|[".,'’‘“”]+$""", ""))

    def chosen(parts: Column) -> Column:
        spans = F.transform(F.regexp_extract_all(first_paragraph, F.lit(r"\*([^*]+)\*"), F.lit(1)), lambda s: F.regexp_replace(strip(s), r"[,.;]+$", ""))
        first = F.lower(F.try_element_at(parts, F.lit(1)))
        hit = F.try_element_at(F.filter(spans, lambda s: (s != "") & F.array_contains(plain(s), first)), F.lit(1))
        return let(hit, lambda h: F.when(h.isNull() | ((F.size(plain(h)) == 1) & (F.size(parts) > 1)), title).otherwise(title_case(h)))

    return let(words_of(title), chosen)


# ---- sources ----


def source_url(html: Column) -> Column:
    """The canonical link in a page's own head, else its og:url, else ''."""
    return F.coalesce(*(matched(html, p) for p in URL_PATTERNS), F.lit(""))


# ---- summaries ----


def short_list(values: Column, most: int = 5) -> Column:
    """[a, b, ...] of at most five, then how many more."""
    shown = F.concat(F.lit("["), F.array_join(F.slice(values, 1, most).cast("array<string>"), ", "), F.lit("]"))
    return F.when(F.size(values) <= most, shown).otherwise(F.concat(shown, F.lit(" (+"), (F.size(values) - most).cast("string"), F.lit(" more)")))


def gap_list(gaps: Column, most: int = 3) -> Column:
    """a→b of at most three structs (before, after), then how many in all."""
    shown = F.array_join(F.transform(F.slice(gaps, 1, most), lambda g: F.concat(g["before"].cast("string"), F.lit("→"), g["after"].cast("string"))), ", ")
    return F.when(F.size(gaps) <= most, shown).otherwise(F.concat(shown, F.lit(", … ("), F.size(gaps).cast("string"), F.lit(" total)")))


# ---- words for stand-in prose ----


def portion(total: Column, at: Column, parts: Column) -> Column:
    """A part's share of a number of words: the remainder goes to the first parts, three at least."""
    return F.greatest(F.floor(total / parts) + F.when(at < total % parts, 1).otherwise(0), F.lit(3)).cast("int")


def word_count(text: Column) -> Column:
    """Words of a text, eight at least."""
    return F.greatest(F.size(F.filter(F.split(text, rf"(?U){BLANK}+"), lambda w: w != "")), F.lit(8))


def stand_in(key: Column, count: Column, words: tuple[str, ...]) -> Column:
    """A sentence of so many words, chosen by a hash of the key: the same for the same key."""
    table = F.array(*map(F.lit, words))
    chosen = F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(table, (F.pmod(F.xxhash64(key, i), F.lit(len(words))) + 1).cast("int")))
    comma = F.transform(chosen, lambda w, i: F.when((count > 6) & (i == F.floor(count / 2)), F.concat(w, F.lit(","))).otherwise(w))
    line = F.array_join(comma, " ")
    return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)), F.lit("."))
