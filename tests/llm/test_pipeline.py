"""The pipeline over the smallest table: every stage against plain versions of its decisions."""

import random

import corpus_pipeline
from arborist.llm import decontaminate, quality
from arborist.llm.sentences import split
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_quality import plain as plain_measures
from tests.llm.test_simhash import plain_fingerprint


def write(spark, path):
    rnd = random.Random(12)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in ("a", "en", "ilo", "u") for c in ("", "ka", "mor", "tis", "vel", "xo")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ".\n"]) for _ in range(n))
    passage, item = prose(70), prose(25)
    rows = [(k, prose(rnd.choice([20, 80, 300])), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s1", 0) for k in range(10)]  # copies
    rows += [(200 + k, prose(60) + "\n" + passage + "\n" + prose(60), "en", "s2", 0) for k in range(5)]
    rows += [(300 + k, prose(60) + "\n" + item + "\n" + prose(40), "en", "s0", 0) for k in range(3)]
    rows += [(400, "the same words " * 40, "en", "s0", 0), (401, None, None, None, None), (402, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, passage, item


def test_stages(spark, tmp_path):
    texts, passage, item = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r.asDict() for r in docs.collect()})
    kept, single, spans, clean, packed = seen
    assert set(kept) == {k for k, t in texts.items() if not plain_measures(t)[-1]}
    assert all(kept[k]["text"] == texts[k] for k in kept)  # no line is common here
    firsts = {}
    for k in sorted(kept):
        firsts.setdefault(plain_fingerprint(kept[k]["text"]), k)
    assert set(single) == set(firsts.values())
    whole = [k for k in sorted(spans) if k // 100 == 2 and passage[:200] in spans[k]["text"]]
    assert whole == [200]
    assert all(spans[k]["n_chars"] == len(spans[k]["text"]) for k in spans)
    assert all("".join(s.decode() for s in split(texts[k].encode())) == texts[k] for k in spans)
    for k in clean:
        assert not plain_hits(clean[k]["text"], [(1, item)])[1]
    assert set(clean) == set(spans) and clean[0]["text"] == spans[0]["text"] if 0 in clean else True
    assert set(packed) == set(clean)
    assert quality.MIN_WORDS == 50 and decontaminate.WINDOW == 10


def test_run_equals_the_stages(spark, tmp_path):
    write(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
