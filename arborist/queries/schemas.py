"""Simple types, facets, XML Schema, DTD and RELAX NG validation as error tables, and parsing errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.queries.base import LINES, Registry, engine, keep, parsed, table
from arborist.schema import dtd, rng
from arborist.schema.model import Simple, valid
from arborist.schema.xsd import Schema, Validator

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Facet query: name -> (type, DuckDB predicate over the lexical value v).
FACETS = {
    "length": (Simple(None, "string", [("minLength", "3"), ("maxLength", "12")]), "length(v) BETWEEN 3 AND 12"),
    "pattern": (Simple(None, "token", [("pattern", "[a-z]+ .*"), ("pattern", "Brand#\\d\\d?")]), "regexp_full_match(v, '[a-z]+ .*|Brand#[0-9][0-9]?')"),
    "enumeration": (Simple(None, "integer", [("enumeration", "7"), ("enumeration", "+12")]), "coalesce(TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v END AS INTEGER) IN (7, 12), false)"),
    "bounds": (Simple(None, "decimal", [("minInclusive", "10"), ("maxExclusive", "40.5")]), "coalesce(CASE WHEN regexp_full_match(v, '[0-9]+([.][0-9]+)?') THEN CAST(v AS DOUBLE) >= 10 AND CAST(v AS DOUBLE) < 40.5 END, false)"),
    "digits": (Simple(None, "decimal", [("totalDigits", "3"), ("fractionDigits", "1")]), "coalesce(CASE WHEN regexp_full_match(v, '[0-9]+([.][0-9]+)?') THEN length(replace(v, '.', '')) <= 3 AND length(split_part(v, '.', 2)) <= 1 END, false)"),
    "list": (Simple(None, item=Simple(None, "NCName"), facets=[("maxLength", "2")]), "len(regexp_extract_all(v, '[^ ]+')) <= 2 AND regexp_full_match(v, '[A-Za-z_][-A-Za-z0-9._]*( [A-Za-z_][-A-Za-z0-9._]*)*')"),
    "union": (Simple(None, members=[Simple(None, "integer"), Simple(None, "token", [("pattern", "Brand.*")])]), "regexp_full_match(v, '[0-9]+') OR starts_with(v, 'Brand')"),
}
_LEXICAL = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '.25' ELSE p_brand END AS v FROM part"


def _lexical(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, size).when(k % 4 == 2, F.concat(size, F.lit(".25"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("k"), v.alias("v"))


def _facet(kind):
    return lambda spark, sf_dir: _lexical(spark, sf_dir).select("k", valid(F.col("v"), kind).alias("ok"))


for _name, (_type, _sql) in FACETS.items():
    R.queries[f"xsd_facet_{_name}"], R.oracles[f"xsd_facet_{_name}"] = _facet(_type), f"SELECT k, ({_sql}) AS ok FROM ({_LEXICAL})"

ORDERS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <xs:simpleType name="flag"><xs:restriction base="xs:string"><xs:enumeration value="A"/><xs:enumeration value="N"/></xs:restriction></xs:simpleType>
 <xs:simpleType name="quantity"><xs:restriction base="xs:double"><xs:maxInclusive value="48"/></xs:restriction></xs:simpleType>
 <xs:element name="order"><xs:complexType>
  <xs:sequence><xs:element name="line" maxOccurs="6"><xs:complexType>
    <xs:attribute name="no" type="xs:integer" use="required"/><xs:attribute name="part" type="xs:integer"/><xs:attribute name="supp" type="xs:integer"/>
    <xs:attribute name="qty" type="quantity"/><xs:attribute name="price" type="xs:double"/><xs:attribute name="flag" type="flag"/>
    <xs:attribute name="tax" type="xs:double" use="required"/>
  </xs:complexType></xs:element></xs:sequence>
  <xs:attribute name="id" type="xs:integer" use="required"/><xs:attribute name="cust"/><xs:attribute name="status"/><xs:attribute name="total"/>
  <xs:assert test="sum(line/@price) le 250000"/>
 </xs:complexType>
 <xs:key name="lineKey"><xs:selector xpath="line"/><xs:field xpath="@no"/></xs:key>
 <xs:unique name="partUnique"><xs:selector xpath="line"/><xs:field xpath="@part"/><xs:field xpath="@supp"/></xs:unique>
 <xs:key name="goodParts"><xs:selector xpath="line[@flag = 'N']"/><xs:field xpath="@part"/><xs:field xpath="@no"/></xs:key>
 <xs:keyref name="needsN" refer="needed"><xs:selector xpath="line[@flag = 'R']"/><xs:field xpath="@part"/></xs:keyref>
 <xs:unique name="needed"><xs:selector xpath="line[@flag != 'R']"/><xs:field xpath="@part"/></xs:unique>
 </xs:element>
</xs:schema>"""


def _validator(spark, sf_dir):
    return Validator(Schema(ORDERS), engine(spark, sf_dir, "orders_xml").nodes)


def _count(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@R.add("xsd_content_model", "SELECT o_orderkey AS doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'cvc-complex-type.2.4.b' ELSE 'cvc-complex-type.2.4.a' END AS code, CAST(1 AS BIGINT) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey WHERE coalesce(n, 0) = 0 OR n > 6")
def xsd_content_model(spark, sf_dir):
    v = _validator(spark, sf_dir)
    return _count(v.structure())


@R.add("xsd_attributes", LINES + """SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, 'cvc-complex-type.4' AS code FROM l UNION ALL SELECT doc_id, 'cvc-complex-type.3.2.2' FROM l
 UNION ALL SELECT doc_id, 'cvc-attribute.3' FROM l WHERE l_quantity > 48 UNION ALL SELECT doc_id, 'cvc-attribute.3' FROM l WHERE l_returnflag NOT IN ('A', 'N')) GROUP BY 1, 2""")
def xsd_attributes(spark, sf_dir):
    """tax is required and never there, disc is there and not declared, quantities and flags may be out of range."""
    v = _validator(spark, sf_dir)
    v.typed()
    return _count(v.attribute_errors())


@R.add("xsd_identity", LINES + """SELECT doc_id, message, count(*) AS n FROM (
 SELECT doc_id, 'lineKey' AS message FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, l_linenumber ORDER BY rn) AS k FROM l) WHERE k > 1
 UNION ALL SELECT doc_id, 'partUnique' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, l_partkey, l_suppkey ORDER BY rn) AS k FROM l) WHERE k > 1
 UNION ALL SELECT doc_id, 'goodParts' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, l_partkey, l_linenumber ORDER BY rn) AS k FROM l WHERE l_returnflag = 'N') WHERE k > 1
 UNION ALL SELECT doc_id, 'needed' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, l_partkey ORDER BY rn) AS k FROM l WHERE l_returnflag <> 'R') WHERE k > 1
 UNION ALL SELECT doc_id, 'needsN' FROM l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = doc_id AND x.l_partkey = l.l_partkey AND x.l_returnflag <> 'R')) GROUP BY 1, 2""")
def xsd_identity(spark, sf_dir):
    parts = _validator(spark, sf_dir).identity_errors()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "message").agg(F.count("*").alias("n"))


@R.add("xsd_assert", "SELECT l_orderkey AS doc_id, 'cvc-assertion.3' AS code, CAST(1 AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > 250000")
def xsd_assert(spark, sf_dir):
    v = _validator(spark, sf_dir)
    v.typed()
    return _count(v.assertion_errors())


@R.add("xsd_annotation", "SELECT 'flag' AS t, count(*) AS n FROM (SELECT 1 FROM lineitem) WHERE false GROUP BY 1 UNION ALL SELECT 'event', count(*) FROM events UNION ALL SELECT 'user', count(DISTINCT user_id) FROM events UNION ALL SELECT 'double', count(*) FROM events")
def xsd_annotation(spark, sf_dir):
    schema = Schema("""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="user" type="user"/>
     <xs:complexType name="user"><xs:sequence><xs:element name="event" type="event" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:anyAttribute/></xs:complexType>
     <xs:complexType name="event"><xs:sequence><xs:element name="value" type="xs:double"/></xs:sequence><xs:anyAttribute/></xs:complexType></xs:schema>""")
    found = Validator(schema, engine(spark, sf_dir, "events_xml").nodes).annotated()
    return found.where("type_ann IS NOT NULL").groupBy(F.col("type_ann").alias("t")).agg(F.count("*").alias("n"))


_ITEM = "CASE o_orderstatus WHEN 'F' THEN '<o><a>1</a><c>x</c></o>' WHEN 'O' THEN '<o><b>2</b><a>1</a></o>' ELSE '<o><a>x</a><c/><c/></o>' END"


def _items(spark, sf_dir):
    s = F.col("o_orderstatus")
    made = F.when(s == "F", "<o><a>1</a><c>x</c></o>").when(s == "O", "<o><b>2</b><a>1</a></o>").otherwise("<o><a>x</a><c/><c/></o>")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), made.alias("xml"))


@R.add("xsd_all", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 'cvc-complex-type.2.4.b' ELSE 'cvc-complex-type.2.4.a' END AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'cvc-datatype-valid.1', 1 FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def xsd_all(spark, sf_dir):
    schema = Schema("""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="o"><xs:complexType><xs:all>
     <xs:element name="a" type="xs:integer"/><xs:element name="b" minOccurs="0"/><xs:element name="c"/></xs:all></xs:complexType></xs:element></xs:schema>""")
    return _count(Validator(schema, parsed(_items(spark, sf_dir))).structure())


@R.add("dtd_validate", "SELECT o_orderkey AS doc_id, 'content' AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dtd_validate(spark, sf_dir):
    """Orders without a line, whose content the model does not allow."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<line>"), F.col("l_returnflag"), F.lit("</line>")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(lines, "doc_id", "left")
    texts = orders.select("doc_id", F.concat(F.lit('<order id="'), "doc_id", F.lit('">'), F.coalesce("lines", F.lit("")), F.lit("</order>")).alias("xml"))
    found = dtd.validate(parsed(texts), dtd.parse_dtd("<!ELEMENT order (line+)><!ATTLIST order id CDATA #REQUIRED><!ELEMENT line (#PCDATA)>"))
    return found.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@R.add("dtd_attributes", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, code, CAST(1 AS BIGINT) AS n FROM (SELECT c_custkey, 'enumeration' AS code FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'required' FROM customer UNION ALL SELECT c_custkey, 'idref' FROM customer WHERE c_custkey % 2 = 0)")
def dtd_attributes(spark, sf_dir):
    made = F.concat(F.lit('<c id="x1" seg="'), "c_mktsegment", F.lit('" ref="x'), F.when(F.col("c_custkey") % 2 == 0, "2").otherwise("1"), F.lit('"/>'))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), made.alias("xml"))
    rules = dtd.parse_dtd("<!ELEMENT c EMPTY><!ATTLIST c id ID #REQUIRED seg (BUILDING|MACHINERY) #IMPLIED ref IDREF #IMPLIED must CDATA #REQUIRED>")
    return dtd.validate(parsed(docs), rules).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@R.add("rng_validate", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN '/o' ELSE '/o/a' END AS path FROM orders WHERE o_orderstatus <> 'F'")
def rng_validate(spark, sf_dir):
    grammar = rng.Grammar("""<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes">
     <start><element name="o"><interleave><ref name="a"/><optional><element name="b"><text/></element></optional><element name="c"><text/></element></interleave></element></start>
     <define name="a"><element name="a"><data type="integer"/></element></define></grammar>""")
    return rng.validate(_items(spark, sf_dir), grammar).select("doc_id", "path")


@R.add("shred_refuses_doctype", "SELECT CAST(page_id AS BIGINT) AS doc_id, 'FODC0006' AS code FROM pages WHERE html LIKE '<!DOCTYPE%'")
def shred_refuses_doctype(spark, sf_dir):
    from arborist.sources.shred import shred

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return shred(pages)[1].select("doc_id", "code")


@R.add("shred_round_trip", "SELECT count(*) AS n, count(DISTINCT user_id) AS docs FROM events")
def shred_round_trip(spark, sf_dir):
    """Documents serialized and parsed again have the same events."""
    from arborist.plans.lower import Engine
    from arborist.sources.shred import shred
    from arborist.xslt.serialize import serialize

    text = serialize(engine(spark, sf_dir, "events_xml").nodes)
    again = Engine(keep(shred(text.withColumnRenamed("text", "xml"))[0])).xpath("//event/@type")
    return again.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))




def _schema(body: str, attributes: str = "") -> str:
    return f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" {attributes}>{body}</xs:schema>'


_SCOPES = _schema("""<xs:element name="o"><xs:complexType><xs:sequence><xs:element name="g" maxOccurs="unbounded"><xs:complexType><xs:sequence>
  <xs:element name="k" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:attribute name="v" type="xs:integer"/><xs:attribute name="to" type="xs:decimal"/></xs:complexType></xs:element>
 </xs:sequence></xs:complexType>
 <xs:key name="own"><xs:selector xpath="k"/><xs:field xpath="@v"/></xs:key>
 <xs:keyref name="near" refer="own"><xs:selector xpath="k"/><xs:field xpath="@to"/></xs:keyref></xs:element></xs:sequence></xs:complexType></xs:element>""")


def _identity(spark, sf_dir, made):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), made.alias("xml"))
    return _count(Validator(Schema(_SCOPES), parsed(docs)).identity_errors())


@R.add("xsd_keyref_scope", "SELECT o_orderkey AS doc_id, 'cvc-identity-constraint.4.3' AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F'")
def xsd_keyref_scope(spark, sf_dir):
    """A reference finds the keys of its own group only: F refers to it, O to another group's key, P to none."""
    to = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("3")
    return _identity(spark, sf_dir, F.concat(F.lit('<o><g><k v="1" to="'), to, F.lit('"/></g><g><k v="2"/></g></o>')))


@R.add("xsd_key_values", "SELECT o_orderkey AS doc_id, 'cvc-identity-constraint.4.2.2' AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'cvc-identity-constraint.4.3', 1 FROM orders WHERE o_orderstatus = 'P'")
def xsd_key_values(spark, sf_dir):
    """Keys are numbers: 07 repeats 7 (F), a reference 7.0 finds 7 (O), 7.1 does not (P)."""
    second = F.when(F.col("o_orderstatus") == "F", '<k v="07"/>').when(F.col("o_orderstatus") == "O", '<k v="8" to="7.0"/>').otherwise('<k v="8" to="7.1"/>')
    return _identity(spark, sf_dir, F.concat(F.lit('<o><g><k v="7"/>'), second, F.lit("</g></o>")))


@R.add("xsd_two_namespaces", "SELECT o_orderkey AS doc_id, 'cvc-datatype-valid.1' AS code, CAST(CASE o_orderstatus WHEN 'O' THEN 2 ELSE 1 END AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F'")
def xsd_two_namespaces(spark, sf_dir):
    """Two types called size, an integer and a truth value, each by its own namespace."""
    from arborist.sources.catalog import map_resolver
    other = _schema('<xs:simpleType name="size"><xs:restriction base="xs:boolean"/></xs:simpleType>', 'targetNamespace="urn:b"')
    body = """<xs:import namespace="urn:b" schemaLocation="b"/><xs:element name="o" xmlns:b="urn:b"><xs:complexType><xs:sequence>
      <xs:element name="n" type="size"/><xs:element name="t" type="b:size"/></xs:sequence></xs:complexType></xs:element>
      <xs:simpleType name="size"><xs:restriction base="xs:int"/></xs:simpleType>"""
    s = F.col("o_orderstatus")
    made = F.when(s == "F", "<n>4</n><t>true</t>").when(s == "O", "<n>true</n><t>4</t>").otherwise("<n>4</n><t>4</t>")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('<a:o xmlns:a="urn:a">'), made, F.lit("</a:o>")).alias("xml"))
    schema = Schema(_schema(body, 'targetNamespace="urn:a" xmlns="urn:a"'), resolve=map_resolver({"b": other}))
    return _count(Validator(schema, parsed(docs)).structure())


@R.add("xsd_instance_types", "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'cvc-complex-type.2.4.b' ELSE 'cvc-elt.4.3' END AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F'")
def xsd_instance_types(spark, sf_dir):
    """xsi:type names a derived type with its content (F), without it (O), or a type that is not derived (P)."""
    body = """<xs:element name="o" type="base"/><xs:complexType name="base"/><xs:complexType name="apart"/><xs:complexType name="more"><xs:complexContent><xs:extension base="base">
      <xs:sequence><xs:element name="v"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>"""
    s = F.col("o_orderstatus")
    made = F.when(s == "F", 'xsi:type="more"><v/></o>').when(s == "O", 'xsi:type="more"/>').otherwise('xsi:type="apart"/>')
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('<o xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '), made).alias("xml"))
    return _count(Validator(Schema(_schema(body)), parsed(docs)).structure())


@R.add("xsd_alternatives", "SELECT o_orderkey AS doc_id, 'cvc-complex-type.2.4.b' AS code, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P'")
def xsd_alternatives(spark, sf_dir):
    """The type depends on an attribute: status P needs a reason."""
    body = """<xs:complexType name="any"><xs:attribute name="status"/></xs:complexType><xs:complexType name="held"><xs:complexContent><xs:extension base="any">
      <xs:sequence><xs:element name="reason"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
      <xs:element name="o" type="any"><xs:alternative test="@status = 'P'" type="held"/></xs:element>"""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('<o status="'), "o_orderstatus", F.lit('"/>')).alias("xml"))
    return _count(Validator(Schema(_schema(body)), parsed(docs)).structure())


@R.add("xsd_wildcards", "SELECT o_orderkey AS doc_id, code, CAST(1 AS BIGINT) AS n FROM (SELECT o_orderkey, 'cvc-complex-type.2.4.a' AS code FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'cvc-datatype-valid.1' FROM orders WHERE o_orderstatus = 'P')")
def xsd_wildcards(spark, sf_dir):
    """A lax wildcard of one namespace and names without one: F keeps it, O has another namespace, P a declared element that is not valid."""
    body = """<xs:element name="known" type="xs:int"/><xs:element name="o"><xs:complexType><xs:sequence>
      <xs:any namespace="urn:x ##local" processContents="lax" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>"""
    s = F.col("o_orderstatus")
    made = F.when(s == "F", '<o><x:a xmlns:x="urn:x"/><known>1</known></o>').when(s == "O", '<o><y:a xmlns:y="urn:y"/></o>').otherwise("<o><known>x</known></o>")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), made.alias("xml"))
    return _count(Validator(Schema(_schema(body)), parsed(docs)).structure())
