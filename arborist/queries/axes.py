"""Axes, node tests, predicates, set operations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.queries.base import EVENTS, GEO, LINES, Registry, engine, keep, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

R.table("axis_child", "orders_xml", "/order/line", {"no": "number(@no)", "part": "number(@part)"},
        LINES + "SELECT doc_id, rn AS pos, CAST(l_linenumber AS DOUBLE) AS no, CAST(l_partkey AS DOUBLE) AS part FROM l")
R.xpath("axis_attribute", "orders_xml", "//line/@flag", LINES + "SELECT doc_id, rn AS pos, l_returnflag AS value FROM l")
R.table("axis_parent", "orders_xml", "//line[@flag = 'R']/..", {"id": "number(@id)"},
        "SELECT DISTINCT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_orderkey AS DOUBLE) AS id FROM lineitem WHERE l_returnflag = 'R'")
R.xpath("axis_descendant", "geo_xml", "//customer/name", GEO + "SELECT doc_id, pos, c_name AS value FROM c")
R.xpath("axis_ancestor", "geo_xml", "//customer[@bal > 9000]/ancestor::nation/name",
        GEO + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nk) AS pos, n_name AS value FROM (SELECT DISTINCT doc_id, nk, n_name FROM c WHERE c_acctbal > 9000)")
R.table("axis_descendant_or_self", "geo_xml", "//nation/descendant-or-self::nation", {"n": "count(descendant-or-self::*)"},
        GEO + "SELECT n.doc_id, n.pos, CAST(2 + 2 * coalesce(k.n, 0) AS BIGINT) AS n FROM n LEFT JOIN (SELECT nk, count(*) AS n FROM c GROUP BY nk) k ON k.nk = n.n_nationkey")
R.table("axis_ancestor_or_self", "geo_xml", "//customer", {"n": "count(ancestor-or-self::*)", "up": "string-join(ancestor-or-self::*/name(), '/')"},
        GEO + "SELECT doc_id, pos, CAST(4 AS BIGINT) AS n, 'world/region/nation/customer' AS up FROM c")
R.table("axis_following_sibling", "orders_xml", "//line", {"n": "count(following-sibling::line)"}, LINES + "SELECT doc_id, rn AS pos, n - rn AS n FROM l")
R.table("axis_preceding_sibling", "orders_xml", "//line", {"n": "count(preceding-sibling::line)"}, LINES + "SELECT doc_id, rn AS pos, rn - 1 AS n FROM l")
R.table("axis_following", "geo_xml", "//nation", {"n": "count(following::nation)"},
        GEO + "SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) - pos AS n FROM n")
R.table("axis_preceding", "geo_xml", "//nation", {"n": "count(preceding::customer)"},
        GEO + "SELECT n.doc_id, n.pos, (SELECT count(*) FROM c WHERE c.doc_id = n.doc_id AND c.nk < n.n_nationkey) AS n FROM n")
R.table("axis_self", "orders_xml", "//line/self::line[@flag = 'A']", {"no": "number(@no)"},
        LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE l_returnflag = 'A'")


def _shredded(spark, sf_dir, make):
    """Engine over documents made from the orders by an expression and parsed."""
    from arborist.plans.lower import Engine
    from arborist.sources.shred import shred

    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), make.alias("xml"))
    return Engine(keep(shred(docs)[0]))


@R.add("axis_namespace", "SELECT o_orderkey AS doc_id, 'p' AS name, 'urn:' || o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'q', 'urn:' || o_orderpriority FROM orders")
def axis_namespace(spark, sf_dir):
    made = F.concat(F.lit('<o xmlns:p="urn:'), "o_orderstatus", F.lit('" xmlns:x="urn:x"><l xmlns:q="urn:'), "o_orderpriority", F.lit('" xmlns:p2=""/></o>'))
    made = F.replace(made, F.lit(' xmlns:p2=""'), F.lit(""))
    found = _shredded(spark, sf_dir, made).xpath("//l/namespace::node()")
    return found.where(F.col("name").isin("p", "q")).select("doc_id", "name", "value")


R.table("pred_position", "orders_xml", "/order/line[2]", {"no": "number(@no)"}, LINES + "SELECT doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE rn = 2")
R.table("pred_last", "orders_xml", "/order/line[last()]", {"no": "number(@no)"}, LINES + "SELECT doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE rn = n")
R.table("pred_range", "orders_xml", "/order/line[position() ge 2 and position() lt last()]", {"no": "number(@no)"},
        LINES + "SELECT doc_id, rn - 1 AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE rn >= 2 AND rn < n")
R.table("pred_reverse_axis", "orders_xml", "//line[3]/preceding-sibling::line[1]", {"no": "number(@no)"},
        LINES + "SELECT doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_linenumber AS DOUBLE) AS no FROM l WHERE rn = 2 AND n >= 3")
R.table("pred_exists", "orders_xml", "/order[line/@flag = 'R'][not(line/@flag = 'N')]", {"id": "number(@id)"},
        "SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(l_orderkey AS DOUBLE) AS id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'N')")
R.table("pred_boolean", "orders_xml", "//line[@qty > 30 and (@flag = 'N' or @disc < 0.03)]", {"qty": "number(@qty)"},
        LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, l_quantity AS qty FROM l WHERE l_quantity > 30 AND (l_returnflag = 'N' OR l_discount < 0.03)")
R.xpath("pred_filter", "orders_xml", "(//line/@flag)[position() = 3]", LINES + "SELECT doc_id, CAST(1 AS BIGINT) AS pos, l_returnflag AS value FROM l WHERE rn = 3")
R.xpath("effective_boolean", "orders_xml", "if (//line[@flag = 'R']) then 'some' else ''", "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'some' ELSE '' END AS value FROM orders")
R.xpath("conditional", "orders_xml", "for $l in //line return if ($l/@qty > 25) then 'big' else concat('small', $l/@flag)",
        LINES + "SELECT doc_id, rn AS pos, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' || l_returnflag END AS value FROM l")
R.xpath("node_tests", "geo_xml", "//nation/name/text()", GEO + "SELECT doc_id, pos, n_name AS value FROM n")
R.table("node_tests_kinds", "geo_xml", "/world/region", {"e": "count(.//element())", "a": "count(.//attribute(id))", "t": "count(.//text())", "any": "count(.//node())", "w": "count(*/@*)", "d": "count(/self::document-node())"},
        GEO + """SELECT r_regionkey AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(1 + 2 * a + 2 * b AS BIGINT) AS e, CAST(1 + a + b AS BIGINT) AS a, CAST(1 + a + b AS BIGINT) AS t,
        CAST(2 + 3 * a + 3 * b AS BIGINT) AS any, CAST(a AS BIGINT) AS w, CAST(1 AS BIGINT) AS d FROM region
        JOIN (SELECT doc_id, count(*) AS a FROM n GROUP BY 1) x ON x.doc_id = r_regionkey JOIN (SELECT doc_id, count(*) AS b FROM c GROUP BY 1) y ON y.doc_id = r_regionkey""")
R.table("path_dedup", "geo_xml", "//customer/ancestor::region", {"id": "number(@id)"}, "SELECT r_regionkey AS doc_id, CAST(1 AS BIGINT) AS pos, CAST(r_regionkey AS DOUBLE) AS id FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
R.table("path_rooted_expression", "geo_xml", "for $n in //nation return $n/customer[1]", {"name": "string(name)"},
        GEO + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nk) AS pos, c_name AS name FROM c WHERE rn = 1")
_UNION = "//customer[@bal < 0] {op} //customer[@bal < 5000 and @id mod 2 = 0]"
for _op, _where in (("union", "c_acctbal < 0 OR (c_acctbal < 5000 AND c_custkey % 2 = 0)"), ("intersect", "c_acctbal < 0 AND c_custkey % 2 = 0"), ("except", "c_acctbal < 0 AND NOT c_custkey % 2 = 0")):
    R.table(f"set_{_op}", "geo_xml", _UNION.format(op=_op), {"id": "number(@id)"},
            GEO + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, CAST(c_custkey AS DOUBLE) AS id FROM c WHERE {_where}")
R.table("cmp_general", "orders_xml", "//line[@qty = ../line[@flag = 'R']/@qty]", {"qty": "number(@qty)"},
        LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, l_quantity AS qty FROM l WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = doc_id AND x.l_returnflag = 'R' AND x.l_quantity = l.l_quantity)")
R.xpath("cmp_general_ordered", "orders_xml", "//line[@flag = 'A']/number(@price) > //line[@flag = 'R']/number(@price)",
        "SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS pos, coalesce((SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') > (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), false) AS value FROM orders")
R.table("cmp_value", "orders_xml", "//line", {"lt": "number(@qty) lt 10", "ge": "number(@qty) ge 10", "eq": "string(@flag) eq 'N'", "ne": "string(@flag) ne 'N'"},
        LINES + "SELECT doc_id, rn AS pos, l_quantity < 10 AS lt, l_quantity >= 10 AS ge, l_returnflag = 'N' AS eq, l_returnflag <> 'N' AS ne FROM l")
R.table("cmp_node", "orders_xml", "//line", {"first": ". is ../line[1]", "before": ". << ../line[2]", "after": ". >> ../line[1]"},
        LINES + "SELECT doc_id, rn AS pos, rn = 1 AS first, CASE WHEN n >= 2 THEN rn < 2 END AS before, rn > 1 AS after FROM l")
R.table("cmp_range", "orders_xml", "//line[@qty = 10 to 20]", {"qty": "number(@qty)"},
        LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS pos, l_quantity AS qty FROM l WHERE l_quantity BETWEEN 10 AND 20 AND l_quantity = floor(l_quantity)")
R.table("logic", "orders_xml", "//line", {"both": "@qty > 20 and @disc > 0.05", "either": "@qty > 45 or @flag = 'R'", "neither": "not(@qty > 45 or @flag = 'R')"},
        LINES + "SELECT doc_id, rn AS pos, l_quantity > 20 AND l_discount > 0.05 AS both, l_quantity > 45 OR l_returnflag = 'R' AS either, NOT (l_quantity > 45 OR l_returnflag = 'R') AS neither FROM l")
R.table("arith_double", "orders_xml", "//line", {"add": "@qty + @no", "sub": "@no - @qty", "mul": "@qty * 2", "neg": "-(@qty)", "quo": "@price div @qty", "zero": "@qty div 0"},
        LINES + "SELECT doc_id, rn AS pos, l_quantity + l_linenumber AS add, l_linenumber - l_quantity AS sub, l_quantity * 2 AS mul, -l_quantity AS neg, l_extendedprice / l_quantity AS quo, CAST('Infinity' AS DOUBLE) AS zero FROM l")
R.table("arith_integer", "orders_xml", "//line", {"div": "xs:integer(@part) idiv 7", "mod": "xs:integer(@part) mod 7", "neg": "(0 - xs:integer(@part)) mod 7", "negd": "(0 - xs:integer(@part)) idiv 7"},
        LINES + "SELECT doc_id, rn AS pos, l_partkey // 7 AS div, l_partkey % 7 AS mod, -(l_partkey % 7) AS neg, -(l_partkey // 7) AS negd FROM l")
R.table("arith_decimal", "orders_xml", "//line", {"third": "xs:integer(@no) div 3", "sum": "xs:decimal('0.1') + xs:decimal('0.2')"},
        LINES + "SELECT doc_id, rn AS pos, round(CAST(l_linenumber AS DOUBLE) / 3, 9) AS third, CAST(0.3 AS DOUBLE) AS sum FROM l", {"third": "decimal(20,9)", "sum": "double"})
QUERIES["arith_decimal"] = (lambda f: lambda spark, sf: f(spark, sf).withColumn("third", F.col("third").cast("double")))(QUERIES["arith_decimal"])
R.xpath("sequence_constructor", "orders_xml", "(//line[1]/@flag, 'x', //line[2]/@flag)",
        LINES + "SELECT doc_id, CAST(rn + (CASE WHEN rn = 2 THEN 1 ELSE 0 END) AS BIGINT) AS pos, l_returnflag AS value FROM l WHERE rn <= 2 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 2 ELSE 1 END, 'x' FROM orders")
R.xpath("range_expression", "orders_xml", "for $n in 2 to 4 return $n * count(//line)",
        "SELECT o_orderkey AS doc_id, CAST(k - 1 AS BIGINT) AS pos, CAST(k * (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS value FROM orders, (SELECT unnest([2, 3, 4]) AS k)")
R.table("events_axis", "events_xml", "//event", {"type": "string(@type)", "v": "number(value)"}, EVENTS + "SELECT doc_id, pos, event_type AS type, value AS v FROM e")
