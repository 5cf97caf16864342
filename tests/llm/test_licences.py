import random
import re

from arborist.llm import licences
from arborist.llm.queries import op9_licences


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    ws, found = words(text), []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return len(ws), sorted(found)


TEXTS = [
    None, "", "Released UNDER the\nMIT-license. Under the MIT license", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Nothing of the kind, with the software and the rights to it in any form", "apache license version 23", "é under the mit license é",
    "head. " + licences.TEMPLATES["mit"].upper() + " tail", "x " + " ".join(licences.TEMPLATES["bsd"].split()[5:]) + " y",
]


def test_base_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    pool = "under the mit license apache version 2 cc by nc , x".split()
    texts = TEXTS + [" ".join(rnd.choice(pool) for _ in range(60)) for _ in range(50)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, base int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_licences(spark, str(tmp_path)).collect():
        n, found = plain(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_spans_of_templates(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, TEXTS[10])], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    labels = lambda k: {s.label for s in got[k].spans}
    assert labels(6) == {"gpl-3"} and labels(10) == {"mit"} and labels(11) == {"bsd"} and labels(7) == set()
    span = next(s for s in got[10].spans if s.label == "mit")
    assert (span.start, span.end, span.score) == (1, 1 + len(words(licences.TEMPLATES["mit"])), 1.0)
    assert licences.scan(docs.limit(0)).count() == 0


def matched(item, ws):
    """Longest run of item words ending at each word, by brute force."""
    runs = {tuple(item[i:j]) for i in range(len(item)) for j in range(i + 1, len(item) + 1)}
    return [max((n for n in range(1, at + 1) if tuple(ws[at - n : at]) in runs), default=0) for at in range(1, len(ws) + 1)]


def test_matches_are_the_maximal_ones():
    rnd = random.Random(2)
    item = [f"w{rnd.randrange(6)}" for _ in range(30)]
    scanner = licences.Scanner({"one": " ".join(item)}, {})
    for _ in range(30):
        ws = [f"w{rnd.randrange(7)}" for _ in range(40)]
        best = matched(item, ws)
        want = {(at + 1 - n, n) for at, n in enumerate(best) if n >= licences.SEED and (at + 1 == len(ws) or best[at + 1] <= n)}
        got = scanner.matches([w.encode() for w in ws])
        assert {(at, n) for _, at, _, n in got} == want
        assert all(item[p : p + n] == ws[at : at + n] for _, at, p, n in got)


def chained(pieces, size):
    """For each text start, the most template words that matches in order can cover from there, trying all of them."""
    best = {}

    def go(at, used, covered, first):
        best[first] = max(best.get(first, 0), covered)
        for k in range(at, len(pieces)):
            text, place, n = pieces[k]
            end, upto = used
            skip = max(0, end - text, upto - place)
            if text - end <= licences.GAP and skip < n:
                go(k + 1, (text + n, place + n), covered + n - skip, first)

    for k, (text, place, n) in enumerate(pieces):
        go(k + 1, (text + n, place + n), n, text)
    return best


def test_chains_against_all_chains():
    rnd = random.Random(8)
    item = [f"w{k}" for k in range(40)]
    scanner = licences.Scanner({"one": " ".join(item)}, {})
    many = 0
    for _ in range(60):
        ws = []
        while len(ws) < 90:
            at = rnd.randrange(36)
            ws += item[at : at + rnd.randrange(3, 14)] + ["x"] * rnd.choice([0, 1, 3, 60])
        pieces = sorted({(at, place, n) for _, at, place, n in scanner.matches([w.encode() for w in ws])})
        want = chained(pieces, len(item))
        got = scanner.chains([w.encode() for w in ws])
        many += len(got) > 1
        # a chain found is possible, and the best of all chains is found
        assert all(covered <= want[start] for _, start, _, covered in got)
        assert max(c for *_, c in got) == max(want.values())
    assert many > 20


def test_every_covered_notice_has_a_span():
    text = licences.TEMPLATES["mit"]
    n = len(words(text))
    for between in (0, 1, 60, 500):
        ws = [w.encode() for w in words(" ".join([text, "x " * between, text, "x " * between, " ".join(text.split()[4:])]))]
        got = licences.Scanner().spans(ws, 0.6)
        assert [(s, label) for s, _, label, _ in got] == [(0, "mit"), (n + between, "mit"), (2 * n + 2 * between, "mit")]
    both = licences.TEMPLATES["mit"] + " " + licences.PARTS["mit:conditions"]
    assert [x[2:] for x in licences.Scanner().spans([w.encode() for w in words(both)], 0.6)] == [("mit", 1.0), ("mit", 1.0)]
    names = ["cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa"]
    for name in names:
        text = (licences.TEMPLATES | licences.PARTS)[name]
        assert [x[2] for x in licences.Scanner().spans([w.encode() for w in words(text)], 0.6)] == [name]
