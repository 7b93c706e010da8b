"""Rules for transcripts and summaries in Vietnamese, and for what may be shown of errors, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import strings

#: Words that mark a language, and number words.
SUMMARY_WORDS = (
    "bản", "bị", "các", "cho", "có", "của", "đã", "đang", "đến", "được", "khi", "không", "là", "một", "người", "những", "sau",
    "sẽ", "tại", "theo", "tiếng", "tóm", "trong", "từ", "và", "về", "với", "yêu",
)
TRANSCRIPT_WORDS = (
    "bão", "bị", "các", "cho", "có", "của", "đã", "đang", "đến", "được", "hôm", "khi", "không", "là", "một", "nay", "người",
    "những", "số", "tại", "theo", "trong", "từ", "và", "vào", "về", "với",
)
ENGLISH_WORDS = (
    "a", "about", "and", "are", "as", "at", "for", "from", "in", "is", "local", "of", "on", "report", "response", "that", "the",
    "this", "to", "was", "were", "with",
)
NUMBER_WORDS = (
    "không", "một", "mốt", "hai", "ba", "bốn", "tư", "năm", "lăm", "sáu", "bảy", "tám", "chín", "mười", "mươi", "trăm", "nghìn",
    "triệu", "tỷ", "phẩy",
)
#: Formats that must not leak, numbers with their units, list items, keys of secrets.
LEAKED = r"(?i)(?:```|\{\s*[\"']?cleaned_text[\"']?\s*:)"
LEAKED_START = r'(?i)^\s*(?:```json\s*)?\{\s*"cleaned_text"\s*:'
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?\p{Nd}+(?:[.,]\p{Nd}+)*(?:%|°[CF])?(?![\p{L}\p{N}_])"
LIST_ITEM = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"
SECRET_KEYS = ("password", "passwd", "token", "secret", "authorization", "credential", "vector", "embedding")
#: Letters with a breve or a horn once decomposed, the marks themselves, and the barred d.
_BREVE_HORN = "̛̆"
MARKED = "đ" + _BREVE_HORN + "".join(c for c in map(chr, range(0xC0, 0x1F00)) if set(unicodedata.normalize("NFD", c)) & set(_BREVE_HORN))


def letters(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def _among(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda w: w.isin(*words))


def is_vietnamese(c: Column) -> Column:
    """Two letters beyond ASCII, and enough common words or letters of Vietnamese spelling for the length. Null: false."""
    text = strings.strip(c)
    n = F.size(letters(text))
    words = F.size(_among(letters(text), SUMMARY_WORDS)) >= F.when(n < 10, 1).otherwise(2)
    spelling = F.regexp_count(F.lower(text), F.lit(f"[{MARKED}]")) >= F.when(n < 10, 2).otherwise(F.greatest(F.lit(3), F.floor(n / 20)))
    beyond = F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) >= 2
    return F.coalesce(beyond & (words | spelling), F.lit(False))


def summary_fault(summary: Column, source: Column) -> Column:
    """`language`, `format` or `too_short`; null for a summary that may stand. Long ones are cut by extract_summary."""
    short = strings.is_informative(source) & (F.size(strings.words(summary)) < strings.MIN_SUMMARY_WORDS)
    return F.when(~is_vietnamese(summary), "language").when(strings.strip(summary).rlike(LIST_ITEM), "format").when(short, "too_short")


def cleaning_fault(cleaned: Column, raw: Column) -> Column:
    """`empty`, `format`, `expansion`, `numbers` or `language`; null where the cleaned text may replace the raw one."""
    new, old = strings.collapse(cleaned), strings.collapse(F.coalesce(raw, F.lit("")))
    n = F.greatest(F.length(old), F.lit(1))
    figures = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))
    spelt = lambda c: F.array_sort(_among(letters(c), NUMBER_WORDS))
    english, own = F.size(_among(letters(new), ENGLISH_WORDS)), F.size(_among(letters(new), TRANSCRIPT_WORDS))
    return (
        F.when(F.coalesce(new, F.lit("")) == "", "empty")
        .when(new.rlike(LEAKED), "format")
        .when(F.length(new) > F.greatest(2 * n, n + 80), "expansion")
        .when((figures(new) != figures(old)) | (spelt(new) != spelt(old)), "numbers")
        .when((english >= 4) & (english > 2 * own), "language")
    )


def text_to_summarise(raw: Column, cleaned: Column) -> Column:
    """The cleaned text unless it is empty, leaks its JSON or is over twice and over 256 characters longer; else the raw one."""
    a, b = (F.coalesce(strings.strip(c), F.lit("")) for c in (raw, cleaned))
    more = (F.length(b) > 2 * F.length(a)) & (F.length(b) - F.length(a) > 256)
    return F.when(b == "", a).when(a == "", b).when(b.rlike(LEAKED_START) | more, a).otherwise(b)


def redact_uri(c: Column) -> Column:
    """Scheme, host and port of a URI; nothing else of it may be shown."""
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(:[0-9]*)?(?:[/?#].*)?$"
    host = F.concat(F.regexp_extract(c, parts, 1), F.lit("://"), F.lower(F.regexp_extract(c, parts, 2)), F.regexp_extract(c, parts, 3))
    return F.when(c.rlike(parts), F.regexp_replace(host, ":$", "")).when(c.isNotNull(), "[redacted-uri]")


def redact_detail(key: Column, value: Column) -> Column:
    """The value of a detail as it may be shown: secrets hidden, URIs cut, texts of 500 characters at most."""
    name = F.lower(key)
    secret = F.lit(False)
    for part in SECRET_KEYS:
        secret = secret | name.contains(part)
    cut = F.when(F.length(value) <= 500, value).otherwise(F.concat(F.substring(value, 1, 497), F.lit("...")))
    return F.when(secret, "[redacted]").when(name.contains("uri"), redact_uri(value)).otherwise(cut)


def is_utc_instant(c: Column) -> Column:
    """An ISO 8601 time in UTC, written with Z. Null: false."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?Z$")
    return F.coalesce(shape & F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "Z$", ""), ",", ".")).isNotNull(), F.lit(False))
