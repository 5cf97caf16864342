"""xsl:number: counting of siblings, ancestors and all nodes, and the formatting of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.operators.axes import span, spanned
from arborist.xdm import ATTRIBUTE, ELEMENT, NAMESPACE


def level_single(nodes: DataFrame, matches: Column) -> DataFrame:
    """Matching nodes with number: their place among matching siblings."""
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    return nodes.where(matches).withColumn("number", F.row_number().over(w))


def level_multiple(nodes: DataFrame, matches: Column) -> DataFrame:
    """Matching nodes with numbers: the single numbers of all matching ancestors-or-self, outermost first."""
    single = level_single(nodes, matches)
    up = single.select(F.col("doc_id").alias("__d"), F.col("pre").alias("__p"), F.col("last").alias("__z"), F.col("number").alias("__n"))
    up = spanned(up, "__p", "__z", "__s")
    inside = single.drop("number").join(up, (F.col("__d") == F.col("doc_id")) & (F.col("__s") == span(F.col("pre"))) & (F.col("__p") <= F.col("pre")) & (F.col("__z") >= F.col("pre")))
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__n"))), lambda x: x["__n"])
    return inside.groupBy("doc_id", "pre", "local").agg(numbers.alias("numbers"))


def level_any(nodes: DataFrame, matches: Column, resets: Column | None = None) -> DataFrame:
    """Matching nodes with number: how many matching nodes there are up to them, ancestors left out, since the last reset."""
    rows = nodes.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE)).withColumn("__m", F.coalesce(matches, F.lit(False)).cast("int"))
    upto = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    if resets is not None:
        rows = rows.withColumn("__r", F.sum(F.coalesce(resets, F.lit(False)).cast("int")).over(upto))
    else:
        rows = rows.withColumn("__r", F.lit(0))
    here = Window.partitionBy("doc_id", "__r").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("__c", F.sum("__m").over(here)).where("__m = 1")
    up = counted.select(F.col("doc_id").alias("__d"), F.col("pre").alias("__p"), F.col("last").alias("__z"), F.col("__r").alias("__q"))
    up = spanned(up, "__p", "__z", "__s")
    over = counted.join(up, (F.col("__d") == F.col("doc_id")) & (F.col("__s") == span(F.col("pre"))) & (F.col("__q") == F.col("__r")) & (F.col("__p") < F.col("pre")) & (F.col("__z") >= F.col("pre")), "left")
    return over.groupBy("doc_id", "pre", "local", "__c").agg((F.col("__c") - F.count("__p")).alias("number")).drop("__c")


def alphabetic(n: Column, first: str = "a") -> Column:
    """a, b, ..., z, aa, ab, ...; up to three letters, then the number itself."""
    base = ord(first)
    letter = lambda k: F.char(k + base)
    k = n.cast("bigint") - 1
    one = letter(k % 26)
    two = F.concat(letter(F.floor(k / 26) - 1), one)
    three = F.concat(letter(F.floor((k - 26) / 676) - 1), letter(F.floor((k - 26) / 26) % 26), one)
    return F.when(n < 1, n.cast("string")).when(n <= 26, one).when(n <= 702, two).when(n <= 18278, three).otherwise(n.cast("string"))


#: Roman numerals of thousands, hundreds, tens and ones.
_ROMAN = [("M", None, None), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")]


def roman(n: Column, style: str = "i") -> Column:
    """Roman numerals of 1 to 3999; other numbers as they are."""

    def digit(d: Column, one: str, five: str | None, ten: str | None) -> Column:
        if five is None:
            return F.get(F.array(*[F.lit(one * k) for k in range(4)]), d)
        words = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.get(F.array(*map(F.lit, words)), d)

    k = n.cast("int")
    parts = [digit((F.floor(k / 10 ** (3 - j)) % 10).cast("int"), *_ROMAN[j]) for j in range(4)]
    made = F.concat(*parts)
    return F.when((n < 1) | (n > 3999), n.cast("string")).otherwise(F.lower(made) if style == "i" else made)


def formatted(n: Column, token: str) -> Column:
    """A number by a format token: 1, 01, a, A, i or I."""
    if token in ("a", "A"):
        return alphabetic(n, token)
    if token in ("i", "I"):
        return roman(n, token)
    digits = n.cast("string")
    width = len(token)
    return F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def joined(numbers: Column, token: str = "1", separator: str = ".") -> Column:
    """Several numbers with one token and separator."""
    return F.array_join(F.transform(numbers, lambda n: formatted(n, token)), separator)


def elements(nodes: DataFrame, *names: str) -> Column:
    return (F.col("kind") == ELEMENT) & F.col("local").isin(list(names))
