"""Views of tables: what is kept of them and how plans read it."""

from arborist.plans.lower import Engine
from arborist.sources import views
from arborist.xslt.serialize import serialize, serialize_view

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_elements_are_kept_and_not_shuffled_again(spark):
    view = views.orders_xml(spark, SMALL, 4)
    tables = [spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("orders", "lineitem")]
    assert [h.count() for h in view.held] == tables  # not their nodes, which are over seven times as many
    assert view.nodes.count() == 6 * tables[0] + 8 * tables[1]
    engine = Engine(view.nodes, view=view)
    for text in ("sum(//line/@qty)", "for $l in //line return if ($l/@qty < 10) then 'low' else 'high'"):
        plan = engine.xpath(text)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan and "ENSURE_REQUIREMENTS" not in plan
        assert rows(engine.xpath(text)) == rows(Engine(view.nodes).xpath(text))
    for held in view.held:
        held.unpersist()


def test_kept_views_have_the_nodes_of_others(spark):
    for make in (views.orders_xml, views.geo_xml, views.events_xml):
        kept = make(spark, SMALL, 4)
        assert rows(kept.nodes) == rows(make(spark, SMALL).nodes)
        for held in kept.held:
            held.unpersist()


def test_texts_of_views_need_no_nodes(spark):
    for make in (views.orders_xml, views.geo_xml, views.events_xml, views.conv_xml):
        view = make(spark, SMALL)
        assert rows(serialize_view(view)) == rows(serialize(view.nodes))
    view = views.orders_xml(spark, SMALL, 4)
    plan = serialize_view(view, declaration=False)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Generate explode" not in plan
    for held in view.held:
        held.unpersist()


def test_ancestors_of_a_large_document_meet_by_spans(spark):
    from pyspark.sql import functions as F

    from arborist.operators import numbering
    from arborist.sources.shred import shred

    text = "<r>" + "".join(f"<a><b i='{k}'/></a>" for k in range(300)) + "</r>"
    nodes = shred(spark.createDataFrame([(1, text)], "doc_id long, xml string"))[0]
    found = Engine(nodes).table("//b", up="string-join(ancestor-or-self::*/name(), '/')", n="count(ancestor::node())")
    assert [(r.up, r.n) for r in found.collect()] == [("r/a/b", 3)] * 300
    assert "span" in found._jdf.queryExecution().executedPlan().toString()
    made = numbering.level_multiple(nodes, numbering.elements(nodes, "a", "b")).where("local = 'b'").orderBy("pre")
    assert [list(r.numbers) for r in made.collect()] == [[k + 1, 1] for k in range(300)]
    assert made._jdf.queryExecution().executedPlan().toString().count("__s#") > 0
    assert numbering.level_any(nodes, numbering.elements(nodes, "a", "b")).agg(F.max("number")).first()[0] == 599


def test_parsed_texts_are_kept_by_document(spark):
    from arborist.queries import base

    docs = spark.createDataFrame([(k, "<r><a/></r>") for k in range(20)], "doc_id long, xml string")
    nodes = base.parsed(docs)
    plan = nodes.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert nodes.is_cached and "ENSURE_REQUIREMENTS" not in plan and nodes.count() == 60
