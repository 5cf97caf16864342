"""Streaming, command line, rules and serialization on files."""

import json

from arborist import cli
from arborist.plans.lower import Engine
from arborist.sources.shred import shred
from arborist.streaming.documents import documents, each_batch
from arborist.xslt.rules import Rule, Rules, default_priority
from arborist.xslt.serialize import serialize


def files(folder, texts):
    folder.mkdir()
    for k, t in enumerate(texts):
        (folder / f"{k}.xml").write_text(t)
    return str(folder)


def test_stream_of_documents(spark, tmp_path):
    path = files(tmp_path / "in", ["<a><b>1</b></a>", "<a><b>2</b><b>3</b></a>", "<a>"])
    work = lambda batch: Engine(shred(batch)[0]).xpath("//b")
    for _ in range(2):  # the second run finds nothing new
        each_batch(documents(spark, path), work, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_command_line(spark, tmp_path):
    path = files(tmp_path / "in", ["<a><b n='1'>x</b></a>", "<a/>"])
    rows = lambda *a: cli.run(spark, cli.parser().parse_args([path, *a])).collect()
    assert [r.value for r in rows("--xpath", "//b[@n = $n]", "-p", "n=1")] == ["x"]
    (tmp_path / "s.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a"><xs:complexType><xs:sequence><xs:element name="b"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    assert [r.code for r in rows("--xsd", str(tmp_path / "s.xsd"))] == ["cvc-complex-type.2.4.b"]
    (tmp_path / "r.json").write_text(json.dumps({"assertions": [{"id": "b", "context": "a", "test": "b"}]}))
    assert [r.id for r in rows("--rules", str(tmp_path / "r.json"))] == ["b"]


def test_rules_and_priorities(spark):
    assert [default_priority(p) for p in ("*", "a", "@a", "text()", "a/b", "a[1]", "/", "a | b/c", "node()")] == [-0.5, 0, 0, -0.5, 0.5, 0.5, -0.5, 0.5, -0.5]
    nodes, _ = shred(spark.createDataFrame([(1, "<r><a i='1'/><a i='2'><b>t</b></a><c>u</c></r>")], "doc_id long, xml string"))
    rules = [Rule("a", "concat('a', @i)"), Rule("a[2]", "'second'"), Rule("r/c", "'c'", precedence=-1), Rule("*", "'any'", precedence=-2)]
    found = Rules(Engine(nodes), rules).values("//*").orderBy("pos").collect()
    assert [r.value for r in found] == ["any", "a1", "second", "any", "c"]


def test_serialization_round_trip(spark):
    text = '<a xmlns="u" xmlns:p="v" p:k="&quot;&lt;"><b>x &amp; y</b><!--c--><?i d?><e/></a>'
    nodes, _ = shred(spark.createDataFrame([(1, text)], "doc_id long, xml string"))
    assert serialize(nodes, declaration=False).first().text == text
    assert serialize(nodes, "text").first().text == "x & y"


def test_defaults_are_inserted_in_place(spark):
    from arborist.sources.shred import with_defaults

    texts = [(1, '<r xmlns:p="urn:p"><a x="1"><b/></a><a x="1" d="own"/>t</r>'), (2, "<b><a/></b>")]
    nodes, _ = shred(spark.createDataFrame(texts, "doc_id long, xml string"))
    made = with_defaults(nodes, [("a", "d", "given"), ("b", "e", "E")])
    assert [r.text for r in serialize(made, declaration=False).orderBy("doc_id").collect()] == [
        '<r xmlns:p="urn:p"><a x="1" d="given"><b e="E"/></a><a x="1" d="own"/>t</r>', '<b e="E"><a d="given"/></b>',
    ]
    wanted, _ = shred(spark.createDataFrame([(r.doc_id, r.text) for r in serialize(made, declaration=False).collect()], "doc_id long, xml string"))
    shape = lambda df: sorted((r.doc_id, r.pre, r.last, r.level, r.parent, r.kind, r.local, r.value) for r in df.collect())
    assert shape(made) == shape(wanted)


def test_schemas_named_by_documents(spark):
    import pytest

    from arborist.sources.catalog import map_resolver, validate_by_hints
    from arborist.xdm import XdmError

    schema = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:n"><xs:element name="n" type="xs:int"/></xs:schema>'
    text = '<n xmlns="urn:n" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="urn:n {}">{}</n>'
    docs = spark.createDataFrame([(1, text.format("n.xsd", "1")), (2, text.format("n.xsd", "x")), (3, "<n/>")], "doc_id long, xml string")
    nodes = shred(docs)[0]
    found = validate_by_hints(nodes, ["urn:n"], map_resolver({"n.xsd": schema})).collect()
    assert [(r.doc_id, r.code) for r in found] == [(2, "cvc-datatype-valid.1")]
    assert validate_by_hints(nodes, ["urn:other"], map_resolver({})).count() == 0
    with pytest.raises(XdmError):
        validate_by_hints(nodes, ["urn:n"], map_resolver({}))


def test_registered_functions_and_collations(spark):
    from pyspark.sql import functions as F

    from arborist.functions.strings import register_collation
    from arborist.plans.registry import register_function

    register_function("urn:mine", "initial", 1, lambda c: F.substr(c, F.lit(1), F.lit(1)))
    register_collation("urn:plain", lambda c: F.translate(F.lower(c), "éè", "ee"))
    nodes, _ = shred(spark.createDataFrame([(1, "<r><n>Émile</n><n>Anna</n></r>")], "doc_id long, xml string"))
    engine = Engine(nodes, {"m": "urn:mine"})
    assert [r.value for r in engine.xpath("//n/m:initial(.)").orderBy("pos").collect()] == ["É", "A"]
    assert [r.value for r in engine.xpath("//n/contains(., 'EM', 'urn:plain')").orderBy("pos").collect()] == [True, False]
