import random
import re

from arborist.llm import quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    ws = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(ws) < 50 or 100 * len(hit) > 50 * len(ws),
    )


def texts():
    rnd = random.Random(3)
    pool = ["a", "b", "É", "#x", "ö|", "word"] + [f"w{k}" for k in range(60)]
    out = [None, "", " \t\n", "a", "a b", "a a a a", "a\x0bb\x0cc\rd", "\n\nx\nx\n x", "x " * 3000]
    for n in (3, 10, 60, 200):
        for _ in range(8):
            out.append("".join(rnd.choice(pool) + rnd.choice([" ", "  ", "\n", "\t"]) for _ in range(n)))
    return out


def test_measures_equal_plain(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)) + [(0, None)], "doc_id int, text string")
    got = quality.measures(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert tuple(r)[1:] == plain(rows[r.doc_id]), rows[r.doc_id]


def boilerplate(n=200):
    rnd = random.Random(8)
    prose = lambda k: " ".join(f"v{rnd.randrange(5000)}" for _ in range(k))
    rows = []
    for i in range(n):
        host = "hot" if i % 3 else f"h{i % 5}"
        body = prose(60)
        if host == "hot" and i % 2:
            body += "\nSubscribe  NOW, offer 17 of the day"
        rows.append((i, body, host))
    rows += [(1000 + i, "\n".join([prose(10)] + ["subscribe now, offer 23 of the day " * 1] * 9), "hot") for i in range(2)]
    rows += [(2000 + i, "copied " + rows[0][1], "hot") for i in range(50)]  # exact copies count once
    rows += [(3000, rows[1][1], None), (3001, None, "hot"), (None, rows[2][1], "hot")]
    return rows


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    rows = boilerplate()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (100_000, 0):
        got = quality.judge(docs, broadcast_lines=limit, copies=False).collect()
        assert len(got) == len(rows)
        kept = {r.doc_id for r in got if r.kept}
        assert kept == {i for i, _, _ in rows} - {1000, 1001, 3001}
        text = {r.doc_id: r.clean_text for r in got}
        assert text[1] == rows[1][1].split("\n")[0] and text[3000] == rows[1][1] and text[2000] == rows[-4][1]
    out = quality.clean(docs.withColumn("__host", docs.source), copies=False)
    assert out.columns == ["doc_id", "text", "source", "__host"] and out.count() == len(kept)
    assert quality.clean(docs.limit(0)).count() == 0


def test_documents_or_texts_are_counted_and_a_null_host_is_its_own(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join(f"v{rnd.randrange(5000)}" for _ in range(60))
    copy = prose()
    rows = [(i, copy, "h") for i in range(40)] + [(100 + i, prose(), "h") for i in range(40)]
    rows += [(200 + i, prose() + "\nfooter", None if i % 2 else "") for i in range(50)] + [(300 + i, prose(), None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {c: {r.doc_id: r for r in quality.judge(docs, copies=c).collect()} for c in (True, False)}
    assert [by[True][0].kept, by[False][0].kept] == [False, True]  # a line in 40 documents, but in one text
    for found in by.values():
        assert found[200].clean_text != rows[80][1] and found[201].clean_text == rows[81][1]  # 25 of 25, and 25 of 625 documents
        assert found[100].kept and found[300].kept
