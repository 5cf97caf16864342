import random
import re

from arborist.llm import decontaminate
from arborist.llm.automaton import SuffixAutomaton


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    ws, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(10, len(iw))
        windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else set()
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                names.add(str(name))
    return len(ws), sorted(hit), sorted(names)


def cases(seed):
    rnd = random.Random(seed)
    pool = [f"w{k}" for k in range(9)] + ["É", "zwölf"]
    prose = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [(k, prose(rnd.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for k in range(25)]
    items += [(98, items[3][1]), (99, None), (97, "rare"), (97, "rare")]
    docs = [None, "", "  ", "..."]
    for k in range(60):
        parts = [prose(rnd.randrange(40))]
        if k % 2:
            it = rnd.choice(items)[1] or ""
            parts.append(it.upper() if k % 4 == 1 else it.replace(" ", ", "))
        parts.append(prose(rnd.randrange(20)))
        docs.append("--".join(parts) if k % 3 else " ".join(parts) + " Rare!")
    return items, docs


def test_scan_equals_brute_force(spark):
    for seed, block in ((1, 500_000), (2, 60)):
        items, docs = cases(seed)
        d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)] + [(None, docs[5], 2)], "doc_id int, text string, items int")
        b = spark.createDataFrame(items, "item_id int, text string")
        got = decontaminate.scan(d, b, block_words=block).collect()
        assert len(got) == len(docs) + 1
        for r in got:
            text = docs[5 if r.doc_id is None else r.doc_id]
            hit = [p for s in r.spans for p in range(s.start, s.end)]
            assert (r.n_words, hit, list(r["items"])) == plain(text, items), text


def test_clean_removes_spans_and_keeps_the_rest(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [
        (1, f"Start, here. {passage.upper()}. The end and more words that stay for good, really they do", 7),
        (2, passage + " tail", 7), (3, "untouched  text\n", 7), (4, None, 7), (None, "", 7),
    ]
    d = spark.createDataFrame(docs, "doc_id int, text string, spans int").withColumn("n_chars", decontaminate.F.lit(0))
    b = spark.createDataFrame([(1, passage)], "item_id int, text string")
    out = {r.doc_id: r for r in decontaminate.clean(d, b).collect()}
    assert set(out) == {1, 3, 4, None}
    assert out[1].text == "Start, here. . The end and more words that stay for good, really they do"
    assert out[3].text == "untouched  text\n" and out[3].n_chars == 16 and out[4].text is None
    assert decontaminate.clean(d.limit(0), b).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == 5


def test_automaton_statistics():
    rnd = random.Random(4)
    items = [[rnd.randrange(3) for _ in range(rnd.randrange(12))] for _ in range(6)]
    text = [rnd.randrange(4) for _ in range(300)]
    runs = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i, len(x) + 1)}
    for at, (_, n) in enumerate(SuffixAutomaton(items).statistics(text), 1):
        assert n == max(k for k in range(at + 1) if tuple(text[at - k : at]) in runs or k == 0)
