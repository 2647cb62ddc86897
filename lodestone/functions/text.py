"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode-aware text processing understands them, spelled out: a plain class is matched faster.
WS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as characters, to trim by: that reads the ends of a text, where a pattern is tried at every place of it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = "[A-Za-z0-9_]+"

#: Stop-words of row grounding.
GROUNDING_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with",
]
#: Stop-words of the answer proxies.
PROXY_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "if", "in", "into", "is", "it", "of", "on",
    "or", "that", "the", "their", "then", "there", "these", "this", "to", "was", "were", "with",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.trim(_col(text), F.lit(BLANKS))


def collapse(text: Column | str) -> Column:
    """Stripped text with every run of blanks as one space."""
    return strip(F.regexp_replace(_col(text), f"{WS}+", " "))


def words(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), f"{WS}+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Lower-cased ASCII word tokens; cut before lower-casing, so no other letter turns into one."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def fingerprint(text: Column | str) -> Column:
    return F.sha1(_col(text).cast("binary"))


def boilerplate_key(text: Column | str) -> Column:
    return fingerprint(F.lower(collapse(text)))


def source_unit_id(source: Column | str) -> Column:
    """Identity of a source path: slashes unified, ``.`` parts and repeats dropped, lower case."""
    path = F.regexp_replace(_col(source), r"\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(?:\./)+", "$1")
    path = F.regexp_replace(path, r"(?<=.)/\.?$", "")
    return F.concat(F.lit("su_"), F.substring(F.sha1(F.lower(path).cast("binary")), 1, 16))


def basename(source: Column | str) -> Column:
    return F.substring_index(_col(source), "/", -1)


def parse_ts(text: Column | str) -> Column:
    """Instant of an ISO time, null if blank or unreadable; times without a zone are in the session's."""
    return F.try_to_timestamp(strip(text))


def sentences(text: Column | str) -> Column:
    parts = F.filter(
        F.transform(F.split(_col(text), rf"(?<=[.!?]){WS}+"), strip), lambda s: s != ""
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_col(text)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two token arrays, 0 if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def cells(line: Column | str) -> Column:
    """Non-empty cells of a table line cut at bars and commas."""
    return F.filter(F.transform(F.split(_col(line), r"[|,]"), strip), lambda c: c != "")


def table_line(line: Column | str) -> Column:
    """Comparable form of a table line."""
    parts = cells(line)
    return F.lower(F.when(F.size(parts) < 2, strip(line)).otherwise(F.array_join(parts, " | ")))


def is_header(line: Column | str) -> Column:
    """Two cells or more, half of them with letters, none of them a number."""
    parts = cells(line)
    numeric = F.exists(parts, lambda c: c.rlike(r"^(?:\d+\.?\d*|\.\d+|\d+-?\d*|-\d+)$"))
    lettered = F.size(F.filter(parts, lambda c: c.rlike(r"\p{L}")))
    return (F.size(parts) >= 2) & ~numeric & (lettered >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)))


#: Characters that end a line, beside the usual one.
_OTHER_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def lines(text: Column | str) -> Column:
    """Stripped lines that are not blank; the two characters of one end of line have a blank line between them.

    Nearly all texts have the usual end of line alone, at which they are cut by search, not by a pattern.
    """
    text = _col(text)
    other = F.contains(text, F.lit(_OTHER_ENDS[0]))
    for end in _OTHER_ENDS[1:]:
        other = other | F.contains(text, F.lit(end))
    cut = F.when(other, F.split(text, "[\n" + "".join(_OTHER_ENDS) + "]")).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def grounding_terms(query: Column | str) -> Column:
    stop = F.array(*map(F.lit, GROUNDING_STOPWORDS))
    return F.array_except(F.filter(tokens(query), lambda t: F.length(t) > 1), stop)


def proxy_terms(text: Column | str) -> Column:
    stop = F.array(*map(F.lit, PROXY_STOPWORDS))
    return F.array_except(F.filter(tokens(text), lambda t: F.length(t) >= 3), stop)


def extraction_tier(method: Column | str) -> Column:
    m = F.lower(_col(method))
    return (
        F.when(m.rlike("xlsx|csv|json"), "structured").when(m.rlike("docx|pptx|pdf|html|mhtml"), "document").otherwise("plain")
    )


def hash_index(feature: Column | str, dimension: int) -> Column:
    """First 64 bits of the SHA-1, modulo the dimension, in two 32-bit halves."""
    digest = F.sha1(_col(feature).cast("binary"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return ((high % dimension) * ((1 << 32) % dimension) + low % dimension) % dimension


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(_col(a)) == F.size(_col(b)), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def vector_similarity(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """``cosine`` (of unit vectors) and ``dot`` are the inner product; ``euclidean`` is 1 / (1 + distance)."""
    if metric not in ("euclidean", "l2"):
        return dot(a, b)
    squares = F.zip_with(
        _col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(_col(a)) == F.size(_col(b)), 1 / (1 + F.sqrt(total))).otherwise(0.0)


def number(value: Column | str) -> Column:
    """A value as a number, 0 if it is none."""
    return F.coalesce(_col(value).try_cast("double"), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """A quotient, 0 for a whole of 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def low_fidelity(text: Column | str) -> Column:
    """Whether text from a legacy binary format is too noisy to trust."""
    body = strip(text)
    markers = ["bjbj", " BT ", " DT ", "HYPERLINK", "w:WordDocument"]  # fixed values
    hits = sum((F.when(F.contains(body, F.lit(m)), 1).otherwise(0) for m in markers), F.lit(0))
    letters = F.regexp_count(body, F.lit(r"\p{L}")) / F.greatest(F.length(body), F.lit(1))
    return (body == "") | (letters < 0.6) | (hits >= 2) | F.lower(body).rlike("^(0 )?bjbj")
