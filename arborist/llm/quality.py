"""Quality rules in DataFrame functions: per-document measures and cross-document line frequency.

A line's frequency is the number of documents of its host in which its normal form occurs; where `copies` is not set,
exact copies count as one. Lines above the limits are boilerplate; a document that mostly consists of them is depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import cut

#: White space that separates words, and the same number of spaces.
_WS, _TO = "\t\n\x0b\f\r", "     "

#: A base rule: fewer words than this, or a larger share of words in repeated three-word windows, and a document fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is common in over MIN_DOCS distinct texts of its host that are over MAX_SHARE of the host's texts.
MIN_DOCS, MAX_SHARE = 20, 0.05
#: A document is depleted if its other lines hold less than this share of its words.
MIN_LEFT = 0.3
#: Common lines up to this number are broadcast (8 bytes each and their hosts); more are joined by shuffle.
BROADCAST_LINES = 100_000
#: Parts of a host's common lines by hash; a line is looked up in one of them.
BUCKETS = 256


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _WS, _TO), " "), "")


def _line_hash(line: Column) -> Column:
    """Hash of a line's normal form: lower case, every digit 0, white space as one space."""
    return F.xxhash64(_words(F.translate(F.lower(line), "123456789", "000000000")))


def _has_word(line: Column) -> Column:
    return F.translate(line, " " + _WS, "") != ""


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; null text: no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *keep,
        text.alias("__text"),
        _words(text).alias("__words"),
        F.filter(F.split(text, "\n"), _has_word).alias("__lines"),
    )
    rows = rows.withColumn(
        "__grams",
        F.slice(
            F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))),
            1,
            F.greatest(F.size("__words") - 2, F.lit(0)),
        ),
    )
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    rows = rows.withColumn(
        "__placed",
        F.when(repeats, F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda p, j: p["h"] == F.get("__placed", j)["h"]
    found = F.filter("__placed", lambda p, k: same(p, k - 1) | same(p, k + 1))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(found, lambda p: p["i"])))
    covered = F.transform(
        "__starts", lambda s, k: F.coalesce(F.least(F.get("__starts", k + 1) - s, F.lit(3)), F.lit(3)).cast("bigint")
    )
    return rows.select(
        *keep,
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.translate("__text", " " + _WS, "")).cast("bigint").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.translate("__text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _host(host_col: str) -> Column:
    """A host as a key; a null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))


def common_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, copies: bool = True
) -> DataFrame:
    """(host, lines): the hashes of a host's common lines; hosts without one are absent.

    At most 1 / max_share times the mean number of distinct lines of a host's texts can be common.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(
        _host(host_col).alias("host"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    lines = texts.select(
        "host",
        "text_hash",
        F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _has_word), _line_hash))).alias("line"),
    )
    number = F.count("*") if copies else F.countDistinct("text_hash")  # a document has each of its lines once here
    counts = lines.groupBy("host", "line").agg(number.alias("n")).where(F.col("n") > min_docs)
    sizes = texts.groupBy("host").agg(number.alias("of"))
    return (
        counts.join(sizes, "host")
        .where(F.col("n") > max_share * F.col("of"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    broadcast_lines: int = BROADCAST_LINES,
    copies: bool = True,
) -> DataFrame:
    """Every row's `keep` columns, its measures, n_common_words, kept and clean_text (common lines removed).

    A null text has no words and fails the base rules; repeated rows get equal verdicts; an empty table gives none.
    """
    found = cut(common_lines(docs, text_col, host_col, min_docs, max_share, copies))
    n = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    place = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.filter("lines", lambda h: place(h) == k))
    common = found.select(F.col("host").alias("__host"), parts.alias("__common"))
    rows = docs.withColumn("__host", _host(host_col))
    rows = rows.join(F.broadcast(common) if n <= broadcast_lines else common, "__host", "left")
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    # each line is hashed once
    rows = rows.withColumn("__hashes", F.when(F.col("__common").isNotNull(), F.transform(raw, _line_hash)))
    known = F.transform("__hashes", lambda h: F.array_contains(F.get("__common", place(h)), h))
    rows = rows.withColumn("__known", F.when(F.exists(known, lambda x: x), known)).drop("__hashes", "__common")
    gone_line = lambda x, k: _has_word(x) & F.get("__known", k)
    rows = rows.withColumn("__removed", F.when(F.col("__known").isNotNull(), F.filter(raw, gone_line)))
    rows = rows.withColumn(
        "__clean",
        F.when(F.size("__removed") > 0, F.array_join(F.filter(raw, lambda x, k: ~gone_line(x, k)), "\n")).otherwise(F.col(text_col)),
    )
    gone = F.when(F.size("__removed") > 0, F.size(_words(F.array_join("__removed", " ")))).otherwise(0).cast("bigint")
    measured = measures(rows.withColumn("__gone", gone), text_col, (*keep, "__gone", "__clean"))
    left = F.col("n_words") - F.col("__gone")
    return measured.select(
        *keep,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left >= min_left * F.col("n_words"))).alias("kept"),
        F.col("__gone").alias("n_common_words"),
        F.col("__clean").alias("clean_text"),
    )


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents with all their columns, common lines removed from their texts (and n_chars brought up to date)."""
    others = tuple(c for c in docs.columns if c != text_col)
    named = docs.select(F.col(text_col), *[F.col(c).alias(f"__in_{c}") for c in others], F.col(host_col).alias("__in__host"))
    judged = judge(named, text_col, "__in__host", tuple(f"__in_{c}" for c in others), **limits)
    # the row number keeps the optimizer from pushing the condition below the measures, where it would be expanded without end
    kept = judged.withColumn("__keep", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("__keep")
    out = {c: F.col(f"__in_{c}") for c in others} | {text_col: F.col("clean_text")}
    if "n_chars" in out:
        out["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) for c in docs.columns])


#: The judgement in DuckDB SQL, for the columns of documents.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, raw, nl, nw FROM (
        SELECT doc_id, host, t, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS nw,
               array_to_string(regexp_extract_all(translate(lower(raw), '123456789', '000000000'), '[^\x20\x09-\x0D]+'), ' ') AS nl
        FROM (SELECT doc_id, host, t, unnest(ls) AS raw FROM w)) WHERE nw > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM l GROUP BY doc_id),
s AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
f AS (SELECT x.host, x.nl FROM (SELECT host, nl, count(DISTINCT t) AS n FROM l GROUP BY host, nl) x
      JOIN s ON s.host = x.host WHERE x.n > 20 AND x.n > 0.05 * s.n),
b AS (SELECT doc_id, sum(nw) AS n FROM l SEMI JOIN f ON l.host = f.host AND l.nl = f.nl GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(b.n, 0) AS BIGINT) AS n_common_words
      FROM w LEFT JOIN u ON u.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_common_words >= 0.3 * n_words AS kept FROM v
"""
