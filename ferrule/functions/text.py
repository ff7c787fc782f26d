"""Text functions as Column expressions: tokens, path words, normalisation, labels.

All of them stay in the JVM.  `term` arguments are plain strings known when the plan is made.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    CHARS_PER_TOKEN,
    DIACRITICS,
    FORMAT_WORDS,
    LABEL_STOPWORDS,
    MEDIA_EXTENSIONS,
    OFFICE_EXTENSIONS,
    PLAIN_LETTERS,
    PROFILE_TOKENS,
    RERANK_HEAD,
    SNIPPET_CHARS,
    SOURCE_EXTENSIONS,
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """Evaluates `value` once per row and hands it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- lexical index -------------------------------------------------------------------------
def index_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without diacritics; null gives no words."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # nothing to fold in ASCII
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(text), DIACRITICS, PLAIN_LETTERS))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_WORD, _FOLD = re.compile(r"[^\W_]+"), str.maketrans(DIACRITICS, PLAIN_LETTERS)


def words(text: str | None) -> list[str]:
    """The words of `index_tokens`, cut in Python.  Folding (`fold`) maps letters to letters, so it can
    wait until equal words have met."""
    return _WORD.findall((text or "").lower())


def fold(word: str) -> str:
    return word if word.isascii() else word.translate(_FOLD)


def query_terms(text: str) -> list[tuple[str, bool]]:
    """Terms of user text as (folded word, whether any word it begins counts).  Nothing in it is
    syntax: every run of letters and digits is a word, and only the last, if it has two bytes or
    more, also matches longer words.  No word at all gives an empty list."""
    found = [w.lower() for w in _WORD.findall(text)]
    return [(fold(w), i == len(found) - 1 and len(w.encode()) >= 2) for i, w in enumerate(found)]


def count_term(tokens: Column, term: str, prefix: bool) -> Column:
    hit = (lambda t: t.startswith(term)) if prefix else (lambda t: t == term)
    return F.size(F.filter(tokens, hit))


# --- paths ---------------------------------------------------------------------------------
def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension; a leading dot begins a name, not an extension."""
    return F.translate(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), _UPPER, _LOWER)


def ancestors(path: Column) -> Column:
    """All directories above a path, the topmost first."""
    parts = F.split(F.substring(path, 2, 1 << 20), "/")
    return let(parts, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>")))


def relative_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def path_words(text: Column) -> Column:
    """Words of a path or name: broken where a small letter meets a capital and at everything
    that is no letter or digit; ASCII capitals become small."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.transform(F.regexp_extract_all(broken, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.translate(w, _UPPER, _LOWER))


def name_tokens(text: Column) -> Column:
    """Path words of two bytes or more, the first of equal ones, joined by blanks."""
    return F.array_join(F.array_distinct(F.filter(path_words(text), lambda w: F.octet_length(w) > 1)), " ")


# --- bodies --------------------------------------------------------------------------------
def normalize_ws(text: Column, budget: Column | int) -> Column:
    """Control characters gone, white space single and trimmed, cut to `budget` characters."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cc}&&[^\t\n\x0B\f\r\x85]]", "")
    single = F.ltrim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.rtrim(F.substr(single, F.lit(1), budget if isinstance(budget, Column) else F.lit(budget)))


def markup_text(markup: Column) -> Column:
    """Text of HTML or XML without tags, scripts and styles, white space single; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def snippet(body: Column) -> Column:
    return F.substring(body, 1, SNIPPET_CHARS)


def embed_text(relative: Column, tokens: Column, body: Column) -> Column:
    return F.concat(relative, F.lit("\n"), tokens, F.when(F.length(body) > 0, F.concat(F.lit("\n\n"), body)).otherwise(F.lit("")))


def content_hash(text: Column) -> Column:
    """32 hex digits; only equality of hashes matters."""
    return F.substring(F.sha2(text, 256), 1, 32)


def body_budget(profile: Column) -> Column:
    out = F.lit(0)
    for name, tokens in PROFILE_TOKENS.items():
        out = F.when(profile == name, F.lit(tokens * CHARS_PER_TOKEN)).otherwise(out)
    return out


def extract_kind(path: Column, body: Column, profile: Column, media: bool = False) -> Column:
    """How a file's text is obtained.  An empty body counts as name-only, whatever was tried."""
    ext = extension(path)
    tried = (
        F.when(ext == "pdf", F.lit("pdf"))
        .when(ext.isin(*OFFICE_EXTENSIONS), F.lit("office"))
        .when(ext.isin(*MEDIA_EXTENSIONS), F.lit("media" if media else "name-only"))
        .otherwise(F.lit("text"))
    )
    return F.when((body_budget(profile) == 0) | (F.length(body) == 0), F.lit("name-only")).otherwise(tried)


def is_media(path: Column) -> Column:
    return extension(path).isin(*MEDIA_EXTENSIONS)


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8192, or more than 10 % control bytes there (whole percent)."""
    head = F.hex(F.substring(content, 1, 8192))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    weird = F.regexp_count(pairs, F.lit(r"\b(0[0-8]|0[EF]|1[0-9A-F]) "))
    n = F.least(F.octet_length(content), F.lit(8192))
    return F.when(n == 0, F.lit(False)).otherwise(F.regexp_like(pairs, F.lit(r"\b00 ")) | (F.floor(weird * 100 / n) > 10))


def rerank_text(kind: Column, path: Column, name: Column, body: Column) -> Column:
    return F.when(kind == 1, path).otherwise(F.concat(name, F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, RERANK_HEAD)))


# --- labels --------------------------------------------------------------------------------
def keeps_label_token(t: Column) -> Column:
    """Whether a token may name a topic: not a number, a hash, initials, a partition or a file
    id, and no stop or format word."""
    n = F.octet_length(t)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    bad = (
        (n < 2)
        | (n > 32)
        | t.rlike("^[0-9]+$")
        | t.rlike("^[0-9a-fA-F]{6,}$")
        | ((n == 2) & (digits == 0))
        | t.rlike("^d[0-9a-fA-F]{2}$")
        | t.rlike("^cd[0-9]$")
        | ((digits >= 4) & (n <= 8))
        | t.isin(*LABEL_STOPWORDS, *FORMAT_WORDS)
    )
    return ~bad


def fallback_label(path: Column) -> Column:
    """Parent and extension, or what of them there is, or "topic"."""
    parent = F.translate(file_name(parent_path(path)), _UPPER, _LOWER)
    ext = extension(path)
    label = F.concat_ws(" · ", F.nullif(parent, F.lit("")), F.nullif(ext, F.lit("")))
    return F.when(label == "", F.lit("topic")).otherwise(label)


# --- display -------------------------------------------------------------------------------
def display_path(kind: Column, path: Column) -> Column:
    return F.when(kind == 1, F.concat(F.lit("directory:"), path)).otherwise(path)


def tilde(path: Column, home: str) -> Column:
    return F.when(path == home, F.lit("~")).when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substr(path, F.lit(len(home) + 1)))).otherwise(path)


def elide(text: Column, most: int) -> Column:
    """The end of a text that is longer than `most`, after an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.lit("…"), F.right(text, F.lit(most - 1)))).otherwise(text)


def human_duration(seconds: Column, days: bool = True) -> Column:
    """Whole seconds, minutes, hours or days; without `days`, hours are the largest unit."""
    whole = lambda x: F.floor(x).cast("string")
    hours = F.concat(whole(seconds / 3600), F.lit("h"))
    return (
        F.when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m")))
        .otherwise(F.when(seconds < 86_400, hours).otherwise(F.concat(whole(seconds / 86_400), F.lit("d"))) if days else hours)
    )


def gps_pair(output: Column) -> Column:
    """lat, lon of the last two lines that are not blank, if both are numbers in range."""
    lines = F.filter(F.split(output, "\n"), lambda line: F.trim(line) != "")
    number = lambda line: F.trim(line).try_cast("double")
    pair = let(lines, lambda x: F.struct(number(F.get(x, F.size(x) - 2)).alias("lat"), number(F.get(x, F.size(x) - 1)).alias("lon")))
    return F.when(pair["lat"].between(-90, 90) & pair["lon"].between(-180, 180), pair)


def refresh_due(last_scan: Column, now: Column, interval: int | None) -> Column:
    """"never", "elapsed" or "no"; a last scan in the future counts as just done."""
    if interval is None:
        return F.when(last_scan.isNull(), F.lit("never")).otherwise(F.lit("no"))
    return F.when(last_scan.isNull(), F.lit("never")).when(now - last_scan >= interval, F.lit("elapsed")).otherwise(F.lit("no"))
