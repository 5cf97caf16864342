import random

import corpus_pipeline
from hypothesis import given, settings
from hypothesis import strategies as st

from arborist.llm import queries, sentences
from arborist.llm.common import alnum_words


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab .!?\n\té ") | st.characters(codec="utf-8"), max_size=80))
def test_sentences_join_to_the_text(text):
    assert b"".join(sentences.split(text.encode())) == text.encode()


def test_sentence_ends():
    got = sentences.split("One. Two!  v1.5 is it? Yes...\nA line\n\nEnd".encode())
    assert [s.strip() for s in got if s.strip()] == [b"One.", b"Two!", b"v1.5 is it?", b"Yes...", b"A line", b"End"]
    long = ("word " * 30).encode()
    assert [len(s.split()) for s in sentences.split(long)] == [12, 12, 6]


def plain(rows, run=3):
    """Cleaned texts, by brute force over all runs of all documents in order."""
    parts = {k: [(s, alnum_words(s)) for s in sentences.split((t or "").encode())] for k, t in rows}
    seen, gone = set(), {k: set() for k in parts}
    for k in sorted(parts):
        own = [i for i, (_, w) in enumerate(parts[k]) if w]
        for i in range(len(own) - run + 1):
            key = tuple(b" ".join(parts[k][j][1]) for j in own[i : i + run])
            if sum(len(x.split()) for x in key) < sentences.MIN_RUN_WORDS:
                continue
            if key in seen:
                gone[k] |= set(range(own[i], own[i + run - 1] + 1))
            seen.add(key)
    return {k: b"".join(s for j, (s, _) in enumerate(parts[k]) if j not in gone[k]).decode() for k in parts}


def corpus():
    rnd = random.Random(9)
    prose = lambda n: " ".join(
        " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 3, 6, 30]))) + rnd.choice([".", "!", ".\n", ""]) for _ in range(n)
    )
    passages = [prose(5) for _ in range(6)]
    rows = []
    for k in range(150):
        parts = [prose(rnd.randrange(4))]
        for _ in range(rnd.choice([0, 1, 2])):
            parts += [rnd.choice(passages), prose(rnd.randrange(3))]
        rows.append((k, "\n".join(parts)))
    return rows + [(200, rows[7][1]), (201, ""), (202, None), (203, " \n ")]


def test_dedup_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want = plain(rows)
    for block in (1 << 24, 500):
        monkeypatch.setattr(sentences, "BLOCK_BYTES", block)
        docs = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, __runs int").repartition(5)
        got = {r.doc_id: r.clean_text for r in sentences.dedup(docs.drop("__runs")).collect()}
        assert {k: t or "" for k, t in got.items()} == want
        assert got[202] is None


def test_repeats_nulls_and_columns(spark):
    text = "Alpha beta gamma delta. Epsilon zeta eta theta. Iota kappa la mu. Nu xi omicron."
    rows = [(1, text, "x"), (1, text, "x"), (1, "Before. " + text + " After it.", "y"), (None, text, "z"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = sentences.dedup(docs).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.pos): r for r in got}
    assert by[None, "z"].clean_text == text  # a null id comes first
    assert all(r.clean_text == "" for r in got if r.pos == "x")
    assert by[1, "y"].clean_text == "Before. After it." and by[2, None].clean_text is None
    out = sentences.clean(docs)
    assert out.columns == docs.columns and out.count() == 3
    assert sentences.dedup(docs.limit(0)).count() == 0


def test_passages_at_every_offset(spark):
    rnd = random.Random(21)
    words = lambda n: [f"u{rnd.randrange(10**6)}" for _ in range(n)]
    rows, planted = [], {}
    for n, gap in [(51, " "), (62, "\t"), (116, " "), (55, " \t")]:
        passage = words(n)
        for offset in range(13):
            planted[len(rows)] = passage
            rows.append((len(rows), gap.join(words(offset + rnd.choice([0, 12])) + passage + words(rnd.randrange(20)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.clean_text.split() for r in sentences.dedup(docs).collect()}
    for k, passage in planted.items():
        left = len(set(passage) & set(got[k]))
        assert left == len(passage) if k % 13 == 0 else left <= 27


def test_a_word_put_in_early_moves_no_later_cut():
    rnd = random.Random(22)
    words = [f"u{rnd.randrange(10**6)}" for _ in range(200)]
    one = [s.split() for s in sentences.split(" ".join(words).encode())]
    two = [s.split() for s in sentences.split(" ".join(words[:5] + ["more"] + words[5:]).encode())]
    assert sum(s in one for s in two) >= len(two) - 4 and max(map(len, one)) <= 12


def test_short_sentences_have_runs(spark, tmp_path):
    rnd = random.Random(23)
    words = [f"u{rnd.randrange(10**6)}" for _ in range(155)]
    lines = "\n".join(words)
    said = ". ".join(f"{a} {b}" for a, b in zip(words[:60:2], words[1:60:2], strict=True)) + "."
    rows = [(1, lines), (2, lines), (3, "Before it was\n" + lines + "\nand after it."), (4, said), (5, "No.\n" + said), (6, "one.\ntwo.\nsix."), (7, "one.\ntwo.\nsix.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: lines, 2: "", 3: "Before it was\nand after it.", 4: said, 5: "No.\n", 6: rows[5][1], 7: rows[6][1]}
    assert {r.doc_id: r.text for r in queries.QUERIES["op5_sentence_spans"](spark, str(tmp_path)).collect()} == want
    del want[2]
    assert {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, docs, "").collect()} == want
