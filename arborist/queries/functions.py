"""The scalar function library over names, numbers, dates and lexical values."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.functions import casts, dates, numeric, regex, strings
from arborist.queries.base import GEO, LINES, Registry, engine, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _customers(name: str, columns: dict[str, str], oracle: str, casts_: dict[str, str] | None = None) -> None:
    R.table(name, "geo_xml", "//customer", columns, GEO + f"SELECT doc_id, pos, {oracle} FROM c", casts_)


_customers("str_case", {"u": "upper-case(name)", "l": "lower-case(name)"}, "upper(c_name) AS u, lower(c_name) AS l")
_customers("str_substring", {"a": "substring(name, 3)", "b": "substring(name, 2.5, 4.2)", "c": "substring(name, 0, 3)", "d": "substring(name, -5)"},
           "substr(c_name, 3) AS a, substr(c_name, 3, 4) AS b, substr(c_name, 1, 2) AS c, c_name AS d")
_customers("str_before_after", {"a": "substring-before(name, '#')", "b": "substring-after(name, '#')", "c": "substring-after(name, 'zz')"}, "CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS a, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS b, '' AS c")
_customers("str_contains", {"a": "contains(name, '00')", "b": "starts-with(name, 'Cust')", "c": "ends-with(name, '7')", "d": "contains(name, '')"}, "contains(c_name, '00') AS a, starts_with(c_name, 'Cust') AS b, ends_with(c_name, '7') AS c, true AS d")
_customers("str_collation", {"a": "contains(name, 'CUST', 'http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive')", "b": "compare(name, 'CUSTOMER#000000050')", "d": "default-collation()"},
           "contains(lower(c_name), 'cust') AS a, CASE WHEN c_name < 'CUSTOMER#000000050' THEN -1 WHEN c_name > 'CUSTOMER#000000050' THEN 1 ELSE 0 END AS b, 'http://www.w3.org/2005/xpath-functions/collation/codepoint' AS d")
_customers("str_translate", {"a": "translate(name, '0123#', 'abcd')"}, "translate(c_name, '0123#', 'abcd') AS a")
_customers("str_length", {"a": "string-length(name)", "b": "string-length(.)"}, "CAST(length(c_name) AS BIGINT) AS a, CAST(length(c_name) AS BIGINT) AS b")
_customers("str_concat", {"a": "concat(name, '-', @id, ())"}, "c_name || '-' || c_custkey AS a")
_customers("str_normalize_space", {"a": "normalize-space(concat('  ', translate(name, '#', ' '), '  x '))"}, "trim(regexp_replace(replace(c_name, '#', ' '), ' +', ' ', 'g')) || ' x' AS a")
_customers("str_encode_uri", {"a": "encode-for-uri(concat(name, ' ~*é/'))"}, "replace(c_name, '#', '%23') || '%20~%2A%C3%A9%2F' AS a")
_customers("str_iri", {"a": "iri-to-uri(concat(name, ' é<'))", "b": "escape-html-uri(concat(name, ' é<'))", "c": "resolve-uri(concat('x', @id), 'http://a/b/c')"}, "c_name || '%20%C3%A9%3C' AS a, c_name || ' %C3%A9<' AS b, 'http://a/b/x' || c_custkey AS c")
_customers("str_unicode", {"a": "string-length(normalize-unicode(concat(name, 'é'), 'NFC'))", "b": "codepoint-equal(name, 'x')"}, "CAST(length(c_name) + 1 AS BIGINT) AS a, false AS b")
_customers("re_matches", {"a": "matches(name, '0[1-3]+$')", "b": "matches(name, 'CUST', 'i')", "c": r"matches(name, '^\p{Lu}\c+#\d{9}$')", "q": "matches(name, '.', 'q')"}, "regexp_matches(c_name, '0[1-3]+$') AS a, regexp_matches(lower(c_name), 'cust') AS b, regexp_matches(c_name, '^[A-Z][A-Za-z]+#[0-9]{9}$') AS c, contains(c_name, '.') AS q")
_customers("re_replace", {"a": "replace(name, '0+', '0')", "b": "replace(name, '([A-Za-z]+)#(\\d+)', '$2:$1')"}, "regexp_replace(c_name, '0+', '0', 'g') AS a, regexp_replace(c_name, '([A-Za-z]+)#([0-9]+)', '\\2:\\1', 'g') AS b")
_customers("re_tokenize", {"a": "count(tokenize(name, '0'))", "b": "string-join(tokenize(name, '#'), '|')"}, "CAST(len(string_split(c_name, '0')) AS BIGINT) AS a, replace(c_name, '#', '|') AS b")
_customers("re_subtraction", {"a": "replace(name, '[0-9-[3-5]]', '')", "b": "matches(name, '[a-z-[aeiou]]{2}')"}, "regexp_replace(c_name, '[0126789]', '', 'g') AS a, regexp_matches(c_name, '[bcdfghjklmnpqrstvwxyz]{2}') AS b")
_customers("re_backreference", {"a": r"matches(name, '([1-9])\1')", "b": r"matches(name, '(1+)2\1')"}, "regexp_matches(c_name, '11|22|33|44|55|66|77|88|99') AS a, regexp_matches(c_name, '121') AS b")
_customers("re_blocks", {"a": r"replace(name, '\p{IsBasicLatin}', 'x')", "b": r"matches(name, '\p{IsGreek}')"}, "regexp_replace(c_name, '.', 'x', 'g') AS a, false AS b")


@R.add("re_analyze", "SELECT c_custkey AS k, regexp_replace(c_name, '([0-9]+)', '<\\1>', 'g') AS s, CAST(len(regexp_extract_all(c_name, '[0-9]+')) AS BIGINT) AS n FROM customer")
def re_analyze(spark, sf_dir):
    parts = regex.analyze(F.col("c_name"), "[0-9]+")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), parts.alias("p"))
    shown = F.transform("p", lambda x: F.when(x["matched"], F.concat(F.lit("<"), x["text"], F.lit(">"))).otherwise(x["text"]))
    return rows.select("k", F.array_join(shown, "").alias("s"), F.size(F.filter("p", lambda x: x["matched"])).cast("bigint").alias("n"))


@R.add("str_codepoints", "SELECT c_custkey AS k, list_sum([ascii(x) FOR x IN string_split(c_name, '')]) AS s, reverse(c_name) AS r FROM customer")
def str_codepoints(spark, sf_dir):
    codes = strings.string_to_codepoints(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), codes.alias("c"))
    return rows.select("k", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("s"), strings.codepoints_to_string(F.reverse("c")).alias("r"))


def _lines(name: str, columns: dict[str, str], oracle: str, casts_: dict[str, str] | None = None) -> None:
    R.table(name, "orders_xml", "//line", columns, LINES + f"SELECT doc_id, rn AS pos, {oracle} FROM l", casts_)


_lines("num_number", {"a": "number(@qty)", "b": "number(@flag)"}, "l_quantity AS a, CAST('NaN' AS DOUBLE) AS b")
_lines("num_round", {"a": "round(@price)", "b": "round(0 - @qty - 0.5)", "c": "floor(@price)", "d": "ceiling(@price)", "e": "abs(0 - @qty)"},
       "floor(l_extendedprice + 0.5) AS a, floor(-l_quantity - 0.5 + 0.5) AS b, floor(l_extendedprice) AS c, ceil(l_extendedprice) AS d, l_quantity AS e")
_lines("num_half_even", {"a": "round-half-to-even(@no div 2)", "b": "round-half-to-even(@no * 125, -2)"}, "round_even(l_linenumber / 2.0, 0) AS a, CAST(round_even(l_linenumber * 125 / 100.0, 0) * 100 AS DOUBLE) AS b", {"a": "double", "b": "double"})
_lines("num_format", {"a": "format-number(@qty, '000.00')", "b": "format-number(@part, '#,##0')", "p": "format-number(@disc, '0%')", "n": "format-number(number('x'), '0')"},
       "lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') || '.00' AS a, format('{:,}', l_partkey) AS b, CAST(round_even(l_discount * 100, 0) AS INTEGER) || '%' AS p, 'NaN' AS n")
_lines("num_boolean", {"a": "boolean(@no - 1)", "t": "true()", "f": "not(true())", "s": "boolean(string(@flag))"}, "l_linenumber <> 1 AS a, true AS t, false AS f, true AS s")
_lines("cast_integer", {"a": "xs:integer(@no) * 2", "b": "@flag castable as xs:integer", "c": "@no castable as xs:byte", "d": "xs:integer(@price + 0)", "e": "@part castable as xs:unsignedByte"}, "CAST(l_linenumber * 2 AS BIGINT) AS a, false AS b, true AS c, CAST(trunc(l_extendedprice) AS BIGINT) AS d, l_partkey <= 255 AS e")
_lines("cast_boolean", {"a": "xs:boolean(string(@no = 1))", "b": "@no castable as xs:boolean", "c": "'true' cast as xs:boolean"}, "l_linenumber = 1 AS a, l_linenumber = 1 AS b, true AS c")
_lines("cast_empty", {"a": "() castable as xs:integer?", "b": "() castable as xs:integer", "c": "xs:string(@no) instance of xs:string", "d": "@no instance of attribute(no)", "e": "(1, 2) instance of xs:integer+", "f": "xs:integer(@no) instance of xs:decimal"},
       "true AS a, false AS b, true AS c, true AS d, true AS e, true AS f")


@R.add("cast_lexical", """SELECT k, regexp_full_match(v, '[+-]?[0-9]+') AS i, regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') AS d, v IN ('true', 'false', '1', '0') AS b,
regexp_full_match(v, '[A-Za-z_][-A-Za-z0-9._]*') AS n, regexp_full_match(v, '([0-9a-fA-F]{2})*') AS h FROM (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '+' || p_size || '.5' WHEN 3 THEN 'true' WHEN 4 THEN replace(p_brand, '#', '-') ELSE 'a' || p_size END AS v FROM part)""")
def cast_lexical(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 6 == 0, F.col("p_name")).when(k % 6 == 1, size).when(k % 6 == 2, F.concat(F.lit("+"), size, F.lit(".5"))).when(k % 6 == 3, "true").when(k % 6 == 4, F.replace("p_brand", F.lit("#"), F.lit("-"))).otherwise(F.concat(F.lit("a"), size))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), v.alias("v"))
    kinds = {"i": "integer", "d": "decimal", "b": "boolean", "n": "NCName", "h": "hexBinary"}
    return rows.select("k", *[casts.castable(F.col("v"), t).alias(n) for n, t in kinds.items()])


def _dates(spark, sf_dir):
    m = dates.from_timestamp(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), m.alias("m"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("lexical"))


@R.add("date_parts", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS i, CAST(second(o_orderdate) AS DOUBLE) AS s FROM orders")
def date_parts(spark, sf_dir):
    made = {"y": dates.year, "m": dates.month, "d": dates.day, "h": dates.hours, "i": dates.minutes}
    rows = _dates(spark, sf_dir)
    return rows.select("k", *[f(F.col("m")).cast("bigint").alias(n) for n, f in made.items()], F.floor(dates.seconds(F.col("m"))).cast("double").alias("s"))


@R.add("date_diff", "SELECT o_orderkey AS k, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def date_diff(spark, sf_dir):
    gap = dates.difference(dates.parse_date(F.col("lexical")), dates.parse_date(F.lit("1995-01-01")))
    return _dates(spark, sf_dir).select("k", dates.days_from_duration(gap).alias("days"))


@R.add("date_add", "SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d') || 'Z' AS d FROM orders")
def date_add(spark, sf_dir):
    d = dates.parse_date(F.col("lexical"))
    later = dates.add_micros(dates.parse_date(F.concat("lexical", F.lit("Z"))), dates.parse_day_time(F.lit("P9DT24H")))
    return _dates(spark, sf_dir).select("k", dates.canonical(dates.add_months(d, dates.parse_year_month(F.lit("P1M"))), "date").alias("m"), dates.canonical(later, "date").alias("d"))


@R.add("date_format", "SELECT o_orderkey AS k, strftime(o_orderdate, '%d.%m.%Y') AS a, strftime(o_orderdate, '%A, %-d %B %Y') AS b, strftime(o_orderdate, '%b %y %I:%M %p') AS c FROM orders")
def date_format(spark, sf_dir):
    m = F.col("m")
    return _dates(spark, sf_dir).select("k", dates.format_moment(m, "[D01].[M01].[Y0001]").alias("a"), dates.format_moment(m, "[FNn], [D1] [MNn] [Y]").alias("b"), dates.format_moment(m, "[MNn,3-3] [Y,2-2] [h01]:[m01] [PN]").alias("c"))


@R.add("date_timezone", "SELECT o_orderkey AS k, strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M') AS a, CAST(19800000000 AS BIGINT) AS z, true AS n FROM orders")
def date_timezone(spark, sf_dir):
    utc = dates.moment(F.col("m")["micros"], 0)
    india = dates.adjust(utc, 330)
    return _dates(spark, sf_dir).select("k", F.substr(dates.canonical(india), F.lit(1), F.lit(16)).alias("a"), dates.timezone(india).alias("z"), dates.timezone(F.col("m")).isNull().alias("n"))


@R.add("duration_parts", "SELECT p_partkey AS k, CAST(p_size // 12 AS BIGINT) AS y, CAST(p_size % 12 AS BIGINT) AS m, CAST(-(p_size // 24) AS BIGINT) AS d, CAST(-(p_size % 24) AS BIGINT) AS h FROM part")
def duration_parts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    months, micros = dates.parse_year_month(F.concat(F.lit("P"), size, F.lit("M"))), dates.parse_day_time(F.concat(F.lit("-PT"), size, F.lit("H")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), dates.years_from_months(months).alias("y"), dates.months_from_months(months).cast("bigint").alias("m"), dates.days_from_duration(micros).alias("d"), dates.hours_from_duration(micros).alias("h"))


@R.add("date_compare", "SELECT o_orderkey AS k, o_orderdate < TIMESTAMP '1995-06-17 00:00:00' AS lt FROM orders")
def date_compare(spark, sf_dir):
    edge = dates.parse_datetime(F.lit("1995-06-17T02:00:00+02:00"))
    return _dates(spark, sf_dir).select("k", (dates.instant(F.col("m")) < dates.instant(edge)).alias("lt"))


R.table("date_xpath", "events_xml", "//event[1]", {"y": "year-from-date(xs:date('2004-02-29') + xs:yearMonthDuration('P1Y'))", "d": "day-from-date(xs:date('2004-02-29') + xs:yearMonthDuration('P1Y'))", "h": "hours-from-dateTime(xs:dateTime('2000-01-01T10:00:00Z') + xs:dayTimeDuration('PT5H'))"},
        "SELECT DISTINCT user_id AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(2005 AS BIGINT) AS y, CAST(28 AS BIGINT) AS d, CAST(15 AS BIGINT) AS h FROM events")
R.table("node_names", "geo_xml", "//nation", {"a": "name(.)", "b": "local-name(customer[1]/@id)", "c": "namespace-uri()", "g": "generate-id() ne ''", "e": "name(nothing)"},
        GEO + "SELECT doc_id, pos, 'nation' AS a, CASE WHEN EXISTS (SELECT 1 FROM c WHERE nk = n_nationkey) THEN 'id' ELSE '' END AS b, '' AS c, true AS g, '' AS e FROM n")
R.table("node_misc", "geo_xml", "//region", {"r": "count(/world)", "s": "system-property('xsl:version')", "u": "unparsed-text-available('x')", "f": "function-available('upper-case', 1)", "t": "string(trace(@id, 'x'))"},
        "SELECT r_regionkey AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS r, '2.0' AS s, false AS u, true AS f, CAST(r_regionkey AS VARCHAR) AS t FROM region")


@R.add("node_lang", "SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS value FROM orders")
def node_lang(spark, sf_dir):
    from arborist.queries.axes import _shredded

    made = F.concat(F.lit('<o xml:lang="'), F.when(F.col("o_orderstatus") == "F", "fr-CA").otherwise("en"), F.lit('"><l/></o>'))
    found = _shredded(spark, sf_dir, made).table("//l", value="lang('fr')")
    return found.select("doc_id", "value")


@R.add("node_nilled", "SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS value FROM orders")
def node_nilled(spark, sf_dir):
    from arborist.queries.axes import _shredded

    made = F.concat(F.lit('<o xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="'), (F.col("o_orderstatus") == "F").cast("string"), F.lit('"/>'))
    return _shredded(spark, sf_dir, made).table("/o", value="nilled(.)").select("doc_id", "value")


@R.add("num_text", "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS v FROM part")
def num_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), numeric.double_text(F.col("p_size") / F.lit(2.0)).alias("v"))


_customers("re_dynamic", {"a": "matches(name, concat('0', @id, '$'))", "b": "replace(name, concat(@id, '$'), '!')", "c": "count(tokenize(name, substring(name, 10, 1)))", "d": "translate(name, @id, 'x')"},
           "regexp_matches(c_name, '0' || c_custkey || '$') AS a, regexp_replace(c_name, c_custkey || '$', '!') AS b, CAST(len(string_split(c_name, substr(c_name, 10, 1))) AS BIGINT) AS c, translate(c_name, CAST(c_custkey AS VARCHAR), 'x') AS d")
_customers("qname_parts", {"a": "local-name-from-QName(node-name(.))", "b": "prefix-from-QName(QName('urn:c', concat('p:', local-name())))", "c": "QName('urn:c', 'q:x') eq QName('urn:c', 'x')", "d": "namespace-uri-from-QName(QName('urn:c', 'x'))"},
           "'customer' AS a, 'p' AS b, true AS c, 'urn:c' AS d")
_customers("count_beside", {"a": "count(preceding::customer)", "b": "count(following::customer)"}, "CAST(pos - 1 AS BIGINT) AS a, CAST(count(*) OVER (PARTITION BY doc_id) - pos AS BIGINT) AS b")
_customers("mixed_distinct", {"a": "count(distinct-values((@id, number(@id), 1, true())))", "b": "string-join((@id, 1.5, true()), '|')"}, "CAST(CASE WHEN c_custkey = 1 THEN 3 ELSE 4 END AS BIGINT) AS a, c_custkey || '|1.5|true' AS b")
_customers("codepoints", {"a": "codepoints-to-string(reverse(string-to-codepoints(name)))"}, "reverse(c_name) AS a")
_customers("date_format_language", {"a": "format-date(xs:date('2024-02-29'), '[D] [MNn]', 'en', 'AD', ())", "b": "format-date(xs:date('2024-02-29'), '[Y]', 'de', (), ())", "c": "current-dateTime() ge xs:dateTime('2024-01-01T00:00:00Z')"},
           "'29 February' AS a, '[Language: en]2024' AS b, true AS c")
_customers("node_root", {"a": "count(root(.)/*)", "b": "name(root()/*)", "c": "count(current()/..)"}, "CAST(1 AS BIGINT) AS a, 'world' AS b, CAST(1 AS BIGINT) AS c")


def _shipping(spark, sf_dir):
    """A document for every supplier that names its nation's document, and those of the nations."""
    from arborist.plans.lower import Engine
    from arborist.sources.shred import shred

    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("doc_id"), F.concat(F.lit('<supplier at="n'), "s_nationkey", F.lit('.xml"/>')).alias("xml"), F.concat(F.lit("s"), "s_suppkey", F.lit(".xml")).alias("uri")
    )
    nations = table(spark, sf_dir, "nation").select(
        (-1 - F.col("n_nationkey")).cast("bigint").alias("doc_id"), F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name></nation>")).alias("xml"), F.concat(F.lit("n"), "n_nationkey", F.lit(".xml")).alias("uri")
    )
    nodes = shred(suppliers.unionByName(nations), uri_col="uri")[0]
    return Engine(nodes, collections={"coast": ["n3.xml", "n7.xml"]})


@R.add("doc_join", "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, n_name AS value, true AS known, false AS lost FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def doc_join(spark, sf_dir):
    """doc() in the language: each supplier's nation."""
    found = _shipping(spark, sf_dir).table("/supplier", value="string(doc(@at)/nation/name)", known="doc-available(@at)", lost="doc-available(concat(@at, 'x'))")
    return found.select("doc_id", "value", "known", "lost")


@R.add("collection_named", "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(2 AS BIGINT) AS n, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_nationkey IN (3, 7)) AS names FROM supplier")
def collection_named(spark, sf_dir):
    found = _shipping(spark, sf_dir).table("/supplier", n="count(collection('coast'))", names="string-join(collection('coast')/nation/name, ',')")
    return found.select("doc_id", "n", "names")
