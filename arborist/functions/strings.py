"""String functions of the XPath library as Column expressions; null stands for the empty sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CODEPOINT = "http://www.w3.org/2005/xpath-functions/collation/codepoint"
ASCII_CASELESS = "http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as Unicode has it; normalize-space collapses all of it.
UNICODE_SPACE = "\\x{9}-\\x{d} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

#: Collation URI -> function from a column to one that compares by code points.
COLLATIONS = {CODEPOINT: lambda c: c, ASCII_CASELESS: lambda c: F.translate(c, _UPPER, _LOWER)}


def register_collation(uri: str, fold) -> None:
    """Make a collation known: `fold` turns a column into one that compares by code points as the collation wants."""
    COLLATIONS[uri] = fold


def collation(uri: str | None):
    """The folding of a collation; FOCH0002 for one that is not registered."""
    from arborist.xdm import XdmError

    if uri is None:
        return COLLATIONS[CODEPOINT]
    if uri not in COLLATIONS and ":" not in uri:
        uri = f"{CODEPOINT.rpartition('/')[0]}/{uri}"
    if uri not in COLLATIONS:
        raise XdmError("FOCH0002", f"unknown collation {uri}")
    return COLLATIONS[uri]


def text(c: Column) -> Column:
    """The empty sequence as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def concat(*parts: Column) -> Column:
    return F.concat(*[text(p) for p in parts])


def string_join(items: Column, separator: Column) -> Column:
    """Join of an array of strings; an empty one gives ""."""
    joined = F.aggregate(items, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, separator, x)))
    return F.coalesce(joined, F.lit(""))


def string_length(c: Column) -> Column:
    return F.char_length(text(c)).cast("bigint")


def normalize_space(c: Column) -> Column:
    one = F.regexp_replace(text(c), f"[{UNICODE_SPACE}]+", " ")
    return F.trim(one)


def upper_case(c: Column) -> Column:
    return F.upper(text(c))


def lower_case(c: Column) -> Column:
    return F.lower(text(c))


def contains(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    return F.contains(fold(text(a)), fold(text(b)))


def starts_with(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    return F.startswith(fold(text(a)), fold(text(b)))


def ends_with(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    return F.endswith(fold(text(a)), fold(text(b)))


def substring_before(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    at = F.position(fold(text(b)), fold(text(a)))
    return F.when(text(b) == "", "").when(at > 0, F.substr(text(a), F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    at = F.position(fold(text(b)), fold(text(a)))
    return F.when(text(b) == "", text(a)).when(at > 0, F.substr(text(a), at + F.char_length(text(b)))).otherwise("")


def _round(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("double")


def substring(c: Column, start: Column, length: Column | None = None) -> Column:
    """Characters p with round(start) <= p < round(start) + round(length); NaN and infinities select as that says."""
    s = text(c)
    lo = F.when(F.isnan(start.cast("double")), F.lit(float("inf"))).when(
        F.abs(start.cast("double")) == float("inf"), start.cast("double")
    ).otherwise(_round(start))
    if length is None:
        hi = F.when(F.isnan(start.cast("double")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    else:
        n = length.cast("double")
        size = F.when(F.abs(n) == float("inf"), n).otherwise(_round(length))
        hi = F.when(F.isnan(n) | F.isnan(start.cast("double")), F.lit(float("-inf"))).otherwise(lo + size)
        hi = F.when(F.isnan(hi), F.lit(float("-inf"))).otherwise(hi)
    top = F.char_length(s).cast("double") + 1
    a = F.least(F.greatest(lo, F.lit(1.0)), top).cast("int")
    b = F.least(F.greatest(hi, F.lit(1.0)), top).cast("int")
    return F.when(b > a, F.substr(s, a, b - a)).otherwise("")


def translate(c: Column, source: str, target: str) -> Column:
    """Characters of source become those of target at the same place, or go; the first place of a repeated one counts."""
    seen = dict.fromkeys(source)
    first = {ch: source.index(ch) for ch in seen}
    pairs = [(ch, target[k] if k < len(target) else "") for ch, k in first.items()]
    kept = [p for p in pairs if p[1]] + [p for p in pairs if not p[1]]
    return F.translate(text(c), "".join(a for a, _ in kept), "".join(b for _, b in kept))


def string_to_codepoints(c: Column) -> Column:
    """Array of code points; null for the empty string."""
    return F.when(text(c) != "", F.transform(F.split(text(c), ""), lambda x: F.ascii(x)))


@pandas_udf(StringType())
def _from_codepoints(codes):
    def one(x):
        out = []
        for v in x if x is not None else ():
            v = int(v)
            if not (v in (9, 10, 13) or 0x20 <= v <= 0xD7FF or 0xE000 <= v <= 0xFFFD or 0x10000 <= v <= 0x10FFFF):
                raise ValueError(f"FOCH0001: {v} is no character")
            out.append(chr(v))
        return "".join(out)

    return codes.map(one)


def codepoints_to_string(codes: Column) -> Column:
    return _from_codepoints(codes)


def compare(a: Column, b: Column, uri: str | None = None) -> Column:
    fold = collation(uri)
    x, y = fold(a.cast("string")), fold(b.cast("string"))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def codepoint_equal(a: Column, b: Column) -> Column:
    return a == b


_FORMS = ("NFC", "NFD", "NFKC", "NFKD", "")


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    from arborist.xdm import XdmError

    form = form.strip().upper()
    if form not in _FORMS:
        raise XdmError("FOCH0003", f"unknown form {form}")

    @pandas_udf(StringType())
    def run(s):
        import unicodedata

        return s.map(lambda x: unicodedata.normalize(form, x) if x is not None and form else x)

    return run(text(c))


def encode_for_uri(c: Column) -> Column:
    """Percent-encodes all but letters, digits and - _ . ~ (in the JVM)."""
    u = F.url_encode(text(c))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return u


def _escaped(c: Column, keep) -> Column:
    @pandas_udf(StringType())
    def run(s):
        def one(x):
            return "".join(ch if keep(ord(ch)) else "".join(f"%{b:02X}" for b in ch.encode()) for ch in x or "")

        return s.map(one)

    return run(text(c))


def iri_to_uri(c: Column) -> Column:
    """Percent-encodes what may not stand in a URI: control characters, space, < > " { } | \\ ^ ` and all beyond ASCII."""
    return _escaped(c, lambda o: 0x20 < o < 0x7F and chr(o) not in '<>"{}|\\^`')


def escape_html_uri(c: Column) -> Column:
    """Percent-encodes all beyond printable ASCII."""
    return _escaped(c, lambda o: 0x20 <= o < 0x7F)


def resolve_uri(relative: Column, base: Column) -> Column:
    """A relative reference against a base; FORG0002 where the base is not absolute."""

    @pandas_udf(StringType())
    def run(r, b):
        from urllib.parse import urljoin, urlsplit

        def one(x, y):
            if x is None:
                return None
            if urlsplit(x).scheme:
                return x
            if not urlsplit(y or "").scheme:
                raise ValueError(f"FORG0002: {y} is not absolute")
            return urljoin(y, x) if x else y

        import pandas as pd

        return pd.Series([one(x, y) for x, y in zip(r, b)], dtype=object)

    return run(relative, base)
