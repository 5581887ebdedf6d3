"""Scalar functions as column expressions: names, sizes, dates, messages, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Message patterns in the order they are tried, and what each means. Fixed values.
ERROR_KINDS = [
    (r"(?i)password|encrypted|decrypt|wrong password|incorrect password", "password"),
    (r"(?i)permission denied|access is denied|read.only|readonly|cannot write", "permission"),
    (r"(?i)invalid|corrupt|not a pdf|malformed|bad pdf", "invalid"),
    (r"(?i)no such file|file not found|cannot open|path does not exist", "missing"),
    (r"(?i)no space|disk full|not enough space|storage", "space"),
    (r"(?i)timeout|timed out", "timeout"),
]


def error_kind(message: Column) -> Column:
    kind = F.lit("other")
    for pattern, name in reversed(ERROR_KINDS):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    return kind


def error_text(message: Column, most: int = 280) -> Column:
    """A message without boilerplate, blanks run together, cut with an ellipsis."""
    text = F.regexp_replace(message, r"thread '[^']*' panicked at '[^']*',\s*[^\n]*", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^Error:\s*", ""), r"\s+", " "))
    return F.when(F.length(text) == 0, "unknown error").when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def human_bytes(n: Column) -> Column:
    size = lambda unit, places: F.format_string(f"%.{places}f", n / float(1 << unit))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(size(10, 1), F.lit(" KB"))).when(n < 1 << 30, F.concat(size(20, 1), F.lit(" MB"))).otherwise(F.concat(size(30, 2), F.lit(" GB")))


def relative_time(then: Column, now: Column) -> Column:
    """Epoch milliseconds as how long ago: minutes, hours, days."""
    gap = now - then
    m, h, d = (F.floor(gap / ms) for ms in (60_000, 3_600_000, 86_400_000))
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 24, F.concat(h.cast("string"), F.lit("h ago"))).when(d == 1, "yesterday").otherwise(F.concat(d.cast("string"), F.lit("d ago")))


def pdf_date(millis: Column) -> Column:
    """Epoch milliseconds as D:YYYYMMDDHHMMSSZ; the session is in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(millis / 1000)), "'D:'yyyyMMddHHmmss'Z'")


def parse_pdf_date(text: Column) -> Column:
    """Epoch milliseconds of a date such as D:20240131…; null without a year.

    Missing parts are the least, parts out of range are cut to it, a day past its month's end runs into the next month;
    any zone is ignored.
    """
    digits = F.regexp_extract(F.regexp_replace(text, "^D:", ""), "^[0-9]*", 0)

    def part(start: int, default: int, low: int, high: int) -> Column:
        there = F.length(digits) >= start + 1
        return F.when(there, F.least(F.greatest(F.substring(digits, start, 2).cast("int"), F.lit(low)), F.lit(high))).otherwise(default)

    year = F.substring(digits, 1, 4).cast("int")
    day = F.date_add(F.make_date(year, part(5, 1, 1, 12), F.lit(1)), part(7, 1, 1, 31) - 1)
    seconds = F.unix_date(day).cast("long") * 86400 + part(9, 0, 0, 23) * 3600 + part(11, 0, 0, 59) * 60 + part(13, 0, 0, 59)
    return F.when(F.length(digits) >= 4, seconds * 1000)


def fuzzy_score(target: Column, query: str) -> Column:
    """1000 equal, 500 prefix, 200 contained, 50 letters in order, 0 otherwise; an empty query scores 1."""
    if not query:
        return F.lit(1)
    t, q = F.lower(target), query.lower()
    letters = ".*".join("\\" + c if not c.isalnum() and c.isascii() else c for c in q)
    score = F.when(t == q, 1000).when(t.startswith(q), 500).when(F.instr(t, q) > 0, 200).when(t.rlike("(?s)" + letters), 50).otherwise(0)
    return F.coalesce(score, F.lit(0))


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    """A path with a suffix before its extension."""
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./\\]*)?$", 1), F.lit(suffix), F.regexp_extract(path, r"^(.*?)(\.[^./\\]*)?$", 2))


def mime_type(path: Column) -> Column:
    """By the ending. Fixed values."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    kind = F.lit("application/octet-stream")
    for name, mime in (("pdf", "application/pdf"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp")):
        kind = F.when(ending == name, mime).otherwise(kind)
    return kind


def literal_text(text: Column) -> Column:
    """Printable ASCII only, with backslash and parentheses escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E]", ""), r"([\\()])", r"\\$1")


def swatch(name: Column, colors: int = 10) -> Column:
    """A colour's number by the rolling 32-bit hash 31 h + c of a name's UTF-16 units."""
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    units = F.regexp_extract_all(F.hex(F.encode(name, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % colors


def math_font(name: Column) -> Column:
    """Whether a font name is that of a mathematical face. Fixed values."""
    return F.upper(name).rlike("CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|STIX|EUSM|EUFM|RSFS|MATH|MTMI|MTSY|SYMBOL")


def centred(cx: Column, width: Column, page_cx: Column, page_width: Column) -> Column:
    """A block in the middle of its page, within 4 % of its width, and not as wide as a column."""
    return (page_width > 1) & (F.abs(cx - page_cx) < page_width * 0.04) & (width < page_width * 0.85)


def clamp_zoom(zoom: Column) -> Column:
    return F.least(F.greatest(zoom, F.lit(0.25)), F.lit(3.0))


def snap_zoom(zoom: Column, step: float = 0.1) -> Column:
    """The nearest step of the zoom ladder, within its limits."""
    return clamp_zoom(F.round(zoom / step) * step)


def wheel_zoom(zoom: Column, delta: Column, fit: Column) -> Column:
    """The zoom after a wheel turn; coming within 4 % of the fitting zoom from outside lands on it."""
    new = clamp_zoom(zoom * F.pow(F.lit(0.999), delta))
    near = lambda z: F.abs(z - fit) < fit * 0.04
    return F.when(~near(zoom) & near(new), fit).otherwise(new)


def canonical_real(value: Column) -> Column:
    """A number with up to six decimals, trailing zeros and point left out."""
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def fnv1a_64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as 16 hex digits. The two numbers are fixed values.

    The product is built from two halves, so that it wraps at 64 bits under ANSI arithmetic as well.
    """
    start, prime = 0xCBF29CE484222325, 0x100000001B3
    octets = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    half = 1 << 32
    begin = F.struct(F.lit(start // half).cast("long").alias("high"), F.lit(start % half).cast("long").alias("low"))

    def step(h: Column, octet: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(octet, 16, 10).cast("long"))
        # (high 2^32 + low) * (2^40 + p) modulo 2^64, p being what the prime has below 2^32
        p = prime % half
        product = low * p
        carry = F.shiftrightunsigned(product, 32)
        high = (h["high"] * p + carry + low.bitwiseAND(half // 256 - 1) * 256).bitwiseAND(half - 1)
        return F.struct(high.alias("high"), product.bitwiseAND(half - 1).alias("low"))

    done = F.aggregate(octets, begin, step)
    return F.lower(F.concat(F.lpad(F.hex(done["high"]), 8, "0"), F.lpad(F.hex(done["low"]), 8, "0")))
