"""Aggregates, grouping, numbering, sorting and positional functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.operators import grouping, numbering, sequences, sorting
from arborist.queries.base import EVENTS, GEO, LINES, Registry, engine, keep, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_ONE = "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, {} AS value FROM orders LEFT JOIN (SELECT l_orderkey, {} AS v FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey"
R.xpath("agg_count", "orders_xml", "count(//line[@flag = 'N'])", _ONE.format("coalesce(v, 0)", "count(*) FILTER (WHERE l_returnflag = 'N')"))
R.xpath("agg_sum", "orders_xml", "sum(//line/@qty)", _ONE.format("coalesce(v, 0)", "sum(l_quantity)"))
R.xpath("agg_sum_default", "orders_xml", "sum(//line[@qty > 49]/@qty, -1)", _ONE.format("coalesce(v, -1)", "sum(l_quantity) FILTER (WHERE l_quantity > 49)"))
R.table("agg_avg", "orders_xml", "/order[line]", {"a": "round(avg(line/@qty) * 1000)"}, "SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, floor(avg(l_quantity) * 1000 + 0.5) AS a FROM lineitem GROUP BY 1")
R.table("agg_min", "orders_xml", "/order[line]", {"a": "min(line/@price)"}, "SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, min(l_extendedprice) AS a FROM lineitem GROUP BY 1")
R.table("agg_max", "orders_xml", "/order[line]", {"a": "max(line/@price)"}, "SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, max(l_extendedprice) AS a FROM lineitem GROUP BY 1")
R.xpath("agg_distinct", "orders_xml", "distinct-values(//line/@flag)", LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY m) AS pos, value FROM (SELECT doc_id, l_returnflag AS value, min(rn) AS m FROM l GROUP BY 1, 2)")
R.xpath("agg_count_distinct", "orders_xml", "count(distinct-values(//line/@supp))", _ONE.format("coalesce(v, 0)", "count(DISTINCT l_suppkey)"))
R.xpath("agg_string_join", "orders_xml", "string-join(//line/@flag, ',')", LINES + "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, coalesce(v, '') AS value FROM orders LEFT JOIN (SELECT doc_id, string_agg(l_returnflag, ',' ORDER BY rn) AS v FROM l GROUP BY 1) x ON x.doc_id = o_orderkey")
R.table("agg_exists", "orders_xml", "/order", {"e": "empty(line)", "x": "exists(line[@qty > 45])"}, "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS e, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS x FROM orders")
R.table("range_agg", "orders_xml", "/order", {"n": "count(1 to xs:integer(@cust))", "s": "sum(1 to xs:integer(@cust))", "lo": "min(3 to xs:integer(@cust))", "hi": "max(1 to xs:integer(@cust))"},
        "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, o_custkey AS n, CAST(o_custkey * (o_custkey + 1) // 2 AS BIGINT) AS s, CASE WHEN o_custkey >= 3 THEN CAST(3 AS BIGINT) END AS lo, CASE WHEN o_custkey >= 1 THEN o_custkey END AS hi FROM orders", {"s": "bigint"})


def _events(spark, sf_dir):
    return keep(engine(spark, sf_dir, "events_xml").table("//event", id="number(@id)", type="string(@type)", v="number(value)"))


@R.add("group_by", EVENTS + "SELECT doc_id, event_type AS key, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INTEGER) AS grp FROM e GROUP BY 1, 2")
def group_by(spark, sf_dir):
    found = grouping.group_by(_events(spark, sf_dir), ["doc_id"], F.array("type"), ["pos"], [F.count("*").alias("n")])
    return found.withColumnRenamed("group", "grp")


@R.add("group_multi_key", EVENTS + "SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, event_type AS key FROM e UNION ALL SELECT doc_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END FROM e) GROUP BY 1, 2")
def group_multi_key(spark, sf_dir):
    keys = F.array("type", F.when(F.col("v") > 50, "high").otherwise("low"))
    return grouping.group_by(_events(spark, sf_dir), ["doc_id"], keys, ["pos"], [F.count("*").alias("n")]).drop("group")


@R.add("group_adjacent", EVENTS + """, g AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM e),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM g) SELECT doc_id, CAST(grp AS BIGINT) AS grp, min(event_type) AS key, count(*) AS n FROM h GROUP BY 1, 2""")
def group_adjacent(spark, sf_dir):
    found = grouping.group_adjacent(_events(spark, sf_dir), ["doc_id"], F.col("type"), ["pos"])
    return found.groupBy("doc_id", F.col("group").cast("bigint").alias("grp")).agg(F.min("key").alias("key"), F.count("*").alias("n"))


@R.add("group_starting", EVENTS + ", h AS (SELECT *, sum(CASE WHEN pos = 1 OR value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM e) SELECT doc_id, CAST(grp AS BIGINT) AS grp, count(*) AS n FROM h GROUP BY 1, 2")
def group_starting(spark, sf_dir):
    found = grouping.group_starting(_events(spark, sf_dir), ["doc_id"], F.col("v") > 80, ["pos"])
    return found.groupBy("doc_id", F.col("group").cast("bigint").alias("grp")).agg(F.count("*").alias("n"))


@R.add("group_ending", EVENTS + ", h AS (SELECT *, 1 + coalesce(sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e) SELECT doc_id, CAST(grp AS BIGINT) AS grp, count(*) AS n FROM h GROUP BY 1, 2")
def group_ending(spark, sf_dir):
    found = grouping.group_ending(_events(spark, sf_dir), ["doc_id"], F.col("v") > 80, ["pos"])
    return found.groupBy("doc_id", F.col("group").cast("bigint").alias("grp")).agg(F.count("*").alias("n"))


@R.add("number_single", GEO + "SELECT doc_id, c_custkey AS id, CAST(rn AS BIGINT) AS number FROM c")
def number_single(spark, sf_dir):
    e = engine(spark, sf_dir, "geo_xml")
    ids = e.nodes.where("kind = 2 AND local = 'id'").select("doc_id", F.col("parent").alias("pre"), F.col("value").cast("bigint").alias("id"))
    return numbering.level_single(e.nodes, numbering.elements(e.nodes, "customer")).join(ids, ["doc_id", "pre"]).select("doc_id", "id", F.col("number").cast("bigint").alias("number"))


@R.add("number_multiple", GEO + "SELECT n.doc_id, c_custkey AS id, '1.' || n.pos || '.' || rn AS number FROM c JOIN n ON n.n_nationkey = c.nk")
def number_multiple(spark, sf_dir):
    e = engine(spark, sf_dir, "geo_xml")
    ids = e.nodes.where("kind = 2 AND local = 'id'").select("doc_id", F.col("parent").alias("pre"), F.col("value").cast("bigint").alias("id"))
    found = numbering.level_multiple(e.nodes, numbering.elements(e.nodes, "region", "nation", "customer")).where("local = 'customer'")
    return found.join(ids, ["doc_id", "pre"]).select("doc_id", "id", numbering.joined(F.col("numbers")).alias("number"))


@R.add("number_any", GEO + "SELECT doc_id, c_custkey AS id, pos AS number FROM c")
def number_any(spark, sf_dir):
    e = engine(spark, sf_dir, "geo_xml")
    ids = e.nodes.where("kind = 2 AND local = 'id'").select("doc_id", F.col("parent").alias("pre"), F.col("value").cast("bigint").alias("id"))
    found = numbering.level_any(e.nodes, numbering.elements(e.nodes, "customer"))
    return found.join(ids, ["doc_id", "pre"]).select("doc_id", "id", F.col("number").cast("bigint").alias("number"))


@R.add("number_any_from", GEO + "SELECT doc_id, c_custkey AS id, rn AS number FROM c")
def number_any_from(spark, sf_dir):
    e = engine(spark, sf_dir, "geo_xml")
    ids = e.nodes.where("kind = 2 AND local = 'id'").select("doc_id", F.col("parent").alias("pre"), F.col("value").cast("bigint").alias("id"))
    found = numbering.level_any(e.nodes, numbering.elements(e.nodes, "customer"), numbering.elements(e.nodes, "nation"))
    return found.join(ids, ["doc_id", "pre"]).select("doc_id", "id", F.col("number").cast("bigint").alias("number"))


@R.add("number_formats", """SELECT k, CASE WHEN k <= 26 THEN chr(CAST(96 + k AS INTEGER)) ELSE chr(CAST(96 + (k - 1) // 26 AS INTEGER)) || chr(CAST(97 + (k - 1) % 26 AS INTEGER)) END AS alpha, lpad(CAST(k AS VARCHAR), 3, '0') AS padded,
['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][k // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][k % 10 + 1] AS roman FROM (SELECT DISTINCT l_linenumber * 13 AS k FROM lineitem)""")
def number_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 13).alias("k")).distinct()
    made = {"alpha": "a", "padded": "001", "roman": "I"}
    return rows.select("k", *[numbering.formatted(F.col("k"), t).alias(n) for n, t in made.items()])


R.table("sibling_lag", "orders_xml", "//line", {"before": "preceding-sibling::line[1]/@no", "after": "following-sibling::line[1]/@no"},
        LINES + "SELECT doc_id, rn AS pos, CAST(lag(l_linenumber) OVER w AS VARCHAR) AS before, CAST(lead(l_linenumber) OVER w AS VARCHAR) AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY rn)")
R.table("position_last", "orders_xml", "//line[position() = last() - 1]", {"no": "number(@no)"}, LINES + "SELECT doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE rn = n - 1")


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("p_size"))


@R.add("sort_multi", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_name, p_partkey) AS pos FROM part")
def sort_multi(spark, sf_dir):
    keys = [sorting.Key(F.col("p_brand"), descending=True), sorting.Key(F.col("p_name"))]
    return _global(_parts(spark, sf_dir), keys)


def _global(rows, keys):
    return sorting.positions(rows.withColumn("all", F.lit(1)), ["all"], keys, ["p_partkey"]).select("p_partkey", F.col("pos").cast("bigint").alias("pos"))


@R.add("sort_numeric", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN 1 ELSE 2 END, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END, p_partkey) AS pos FROM part")
def sort_numeric(spark, sf_dir):
    value = F.when(F.col("p_size").cast("int") % 7 == 0, "none").otherwise(F.col("p_size"))
    return _global(_parts(spark, sf_dir), [sorting.Key(value, data_type="number")])


@R.add("sort_case", "SELECT p_partkey, row_number() OVER (ORDER BY lower(n), n, p_partkey) AS pos FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS n FROM part)")
def sort_case(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    return _global(_parts(spark, sf_dir), [sorting.Key(value, case_order="upper-first")])


@R.add("sort_empty_first", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END, p_partkey) AS pos FROM part")
def sort_empty_first(spark, sf_dir):
    return _global(_parts(spark, sf_dir), [sorting.Key(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")))])


@R.add("perform_sort", LINES + "SELECT doc_id, rn AS line, row_number() OVER (PARTITION BY doc_id ORDER BY l_quantity DESC, rn) AS pos FROM l")
def perform_sort(spark, sf_dir):
    lines = engine(spark, sf_dir, "orders_xml").table("//line", qty="string(@qty)").withColumnRenamed("pos", "line")
    found = sorting.positions(lines, ["doc_id"], [sorting.Key(F.col("qty"), descending=True, data_type="number")], ["line"])
    return found.select("doc_id", "line", F.col("pos").cast("bigint").alias("pos"))


@R.add("topk", "SELECT l_orderkey AS doc_id, CAST(round(sum(l_extendedprice), 2) AS DOUBLE) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, doc_id LIMIT 10")
def topk(spark, sf_dir):
    sums = engine(spark, sf_dir, "orders_xml").xpath("sum(//line/@price)").select("doc_id", F.round(F.col("value"), 2).alias("total"))
    return sums.orderBy(F.desc("total"), "doc_id").limit(10)


R.xpath("subsequence", "orders_xml", "subsequence(//line/@flag, 2, 2)", LINES + "SELECT doc_id, rn - 1 AS pos, l_returnflag AS value FROM l WHERE rn IN (2, 3)")
R.xpath("seq_reverse", "orders_xml", "reverse(//line/@flag)", LINES + "SELECT doc_id, n - rn + 1 AS pos, l_returnflag AS value FROM l")
R.xpath("seq_remove", "orders_xml", "remove(//line/@flag, 2)", LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, l_returnflag AS value FROM l WHERE rn <> 2")
R.xpath("seq_insert_before", "orders_xml", "insert-before(//line/@flag, 2, ('x', 'y'))",
        LINES + "SELECT doc_id, CASE WHEN rn < 2 THEN rn ELSE rn + 2 END AS pos, l_returnflag AS value FROM l UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN k + 1 ELSE k END, v FROM orders, (VALUES (1, 'x'), (2, 'y')) AS t(k, v)")
R.xpath("seq_index_of", "orders_xml", "index-of(//line/@flag, 'R')", LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, rn AS value FROM l WHERE l_returnflag = 'R'")
R.xpath("cardinality", "orders_xml", "exactly-one(/order/@status)", "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, o_orderstatus AS value FROM orders")


@R.add("seq_arrays", "SELECT k, n, CASE WHEN n >= 3 THEN a[2] * 10 + a[3] WHEN n = 2 THEN a[2] END AS s FROM (SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS n, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a FROM lineitem GROUP BY 1)")
def seq_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("a")
    )
    items = F.transform("a", lambda x: x["l_linenumber"])
    part = sequences.subsequence(items, F.lit(2), F.lit(2))
    return rows.select("k", F.size("a").cast("bigint").alias("n"), F.reduce(F.slice(part, 2, 10), F.get(part, 0), lambda a, b: a * 10 + b).alias("s"))
