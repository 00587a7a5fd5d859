"""Column expressions for prose: lines, tokens, words, keys, descriptions, escaping.

All of them stay in the JVM; positions and lengths count code points. Null gives null.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F

# The classes that agree with the usual word and space classes on real text.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
TOKEN = rf"{WORD}|{SPACE}+|[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x85\p{{Z}}]"
PLACEHOLDER = r"[\x{E000}-\x{F8FF}\x{100000}-\x{10FFFD}]"
FOOTNOTE_REFERENCE = r"\[\^([^\]\s]+)\]"
FOOTNOTE_DEFINITION = r"^\[\^([^\]\s]+)\]:[ \t]*(.*)$"
MIN_MOVE_CHARS, MIN_WORDS, MIN_CHARS, CONTENT_LETTERS = 20, 4, 15, 4


def split_lines(c: Column) -> Column:
    """Lines of a text: CRLF counts as LF, one last empty line is dropped, '' has none."""
    lines = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def similarity_tokens(c: Column) -> Column:
    """Tokens that aren't blank nor comment placeholders."""
    return F.filter(tokens(c), lambda t: ~t.rlike(f"^(?:{SPACE}|{PLACEHOLDER})"))


def fold(c: Column) -> Column:
    """Case folded as far as German needs it."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def content_words(c: Column) -> Column:
    return F.filter(F.transform(words(c), fold), lambda w: F.length(w) >= CONTENT_LETTERS)


def nonblank_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def move_key(c: Column) -> Column:
    """What an exact move compares; null for lines too short to count as moved."""
    return F.when(nonblank_length(c) >= MIN_MOVE_CHARS, spaced(c))


def long_enough(c: Column) -> Column:
    return (F.size(words(c)) >= MIN_WORDS) & (nonblank_length(c) >= MIN_CHARS)


def quote(c: Column, limit: int = 60) -> Column:
    return F.concat(F.lit('"'), F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c), F.lit('"'))


def describe(old: Column, new: Column) -> Column:
    """What a change does, in words."""
    blank = lambda c: F.regexp_replace(c, SPACE, "") == ""
    return (
        F.when((old != "") & (new != "") & blank(old) & blank(new), "changed spacing")
        .when((old != "") & (new != ""), F.concat(F.lit("changed "), quote(old), F.lit(" to "), quote(new)))
        .when(new != "", F.when(blank(new), "added a space").otherwise(F.concat(F.lit("added "), quote(new))))
        .otherwise(F.when(blank(old), "removed a space").otherwise(F.concat(F.lit("removed "), quote(old))))
    )


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def short_date(c: Column) -> Column:
    """ISO times shortened to the minute; other values stay."""
    pattern = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}).*$"
    return F.when(c.rlike(pattern), F.concat_ws(" ", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))).otherwise(c)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def in_paths(path: Column, wanted: list[str]) -> Column:
    """Equal to one of the paths or below it; no paths means all."""
    hit = F.lit(not wanted)
    for p in wanted:
        p = p.rstrip("/")
        hit = hit | (path == p) | path.startswith(p + "/")
    return hit


def included(path: Column, globs: str | None) -> Column:
    """``|``-separated globs without regard to case; those without ``/`` match the name only."""
    parts = [g.strip().lower() for g in (globs or "").split("|") if g.strip()]
    if not parts:
        return F.lit(True)
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    hit = F.lit(False)
    for g in parts:
        regex = "^" + fnmatch.translate(g).replace(r"\Z", "").replace(r"\z", "").replace("(?s:", "(?s:").rstrip() + "$"
        hit = hit | (F.lower(path) if "/" in g else name).rlike(regex)
    return hit


def natural_key(c: Column) -> Column:
    """Sorts so that 2 comes before 10, in any case: numbers of any length go by their number of digits first."""
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    digits = lambda p: F.concat(F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))
    return F.concat_ws("", F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), digits(p)).otherwise(F.lower(p))))


# The kinds of image that a report shows, and how large they may be.
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp"}
MOST_IMAGE = 5 * 1024 * 1024


def image_uri(path: Column, content: Column) -> Column:
    """An image as a data URI; null for other suffixes and for more than 5 MiB."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGES.items() for x in kv]), suffix_of(path))
    return F.when(kind.isNotNull() & (F.octet_length(content) <= MOST_IMAGE), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content)))


def cut(c: Column, limit: int, what: str = "text") -> Column:
    """At most ``limit`` characters, cut at the last line's end before it, saying how much is left out."""
    head = F.substring(c, 1, limit)
    at = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    kept = F.when(F.instr(head, "\n") > 0, F.left(head, at)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(kept, F.lit("\n["), (F.length(c) - F.length(kept)).cast("string"), F.lit(f" more characters of the {what} left out]")))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,000 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 8000), "ISO-8859-1"), "\x00") > 0


def ordered_similarity(a: Column, b: Column) -> Column:
    """2 LCS / (n + m) over token arrays, as one nested fold (for short lines)."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            same = F.element_at(b, j) == x
            v = F.greatest(F.element_at(acc, -1), F.element_at(prev, j + 1), F.element_at(prev, j) + F.when(same, 1).otherwise(0))
            return F.concat(acc, F.array(v))

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), cell)).otherwise(prev)

    lcs = F.element_at(F.aggregate(a, start, row), -1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2.0 * lcs / (F.size(a) + F.size(b)))
