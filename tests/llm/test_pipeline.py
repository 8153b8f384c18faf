import random

import corpus_pipeline
from lodestone.llm.decontaminate import contamination
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.packing import pieces


def test_stages_take_effect_one_after_another(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = {x: [f"{x}{a}{b}" for a in "abcdefgh" for b in "ijklmnop"] for x in ("en", "de")}
    say = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    item = say("en", 40)
    docs = [(i, say(x, rng.randint(20, 200)), x, "s", 0) for i, x in enumerate(["en", "de"] * 40)]
    base = docs[0][1]
    docs += [(100, base, "en", "s", 0), (101, base + " one more", "en", "s", 0), (102, None, None, "s", 0), (103, "12 34", "en", "s", 0), (104, item + " " + say("en", 30), "en", "s", 0), (105, say("en", 50) + " a@b.com " + say("en", 50), "en", "s", 0), (105, "again under one id " + say("en", 40), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "packing"]
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{sf}/stage{k}")
        before, now = now, spark.read.parquet(f"{sf}/stage{k}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        if k == 1:
            want = {r.doc_id for r in near_duplicates(before, 80).where("kept").collect()}
            assert kept[1] == want and now.groupBy("doc_id").count().where("count > 1").count() == 0
        if k == 2:
            assert kept[2] == kept[1] - {r.doc_id for r in contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    everything = {d[0] for d in docs}
    assert kept[0] == everything - {102, 103}
    assert 100 not in kept[1] and 101 not in kept[1] and kept[1] >= set(range(80))
    assert 104 in kept[1] and 104 not in kept[2]
    texts = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{sf}/stage3").collect()}
    assert all("@" not in t and len(t) == n for t, n in texts.values())
    last = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(last) == key(pieces(spark.read.parquet(f"{sf}/stage3")))


def test_rows_without_ids_repeated_ids_and_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("wa", "the", "lo") for b in "abcdefghijkl"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, clean = say(40), say(60)
    rows = [(i, say(50), "en") for i in range(30)] + [(None, item, "en"), (None, clean, "en"), (50, item + " " + say(20), "en"), (50, say(45), "en"), (51, None, "en"), (52, "", None), (53, say(20000), "en"), (54, clean, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, kept string, contaminated string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    assert key(stage["language"](spark, docs, str(tmp_path))) == sorted((str(i), t) for i, t, _ in rows if t)
    once = stage["near_dedup"](spark, docs, str(tmp_path))
    assert once.columns == docs.columns and key(once) == key(stage["near_dedup"](spark, docs.repartition(5), str(tmp_path)))
    got = key(once)
    assert {i for i, _ in got} == {str(i) for i, _, _ in rows} and [i for i, _ in got].count("50") == 1 and [i for i, _ in got].count("None") == 2
    assert key(stage["decontaminate"](spark, docs, str(tmp_path))) == sorted((str(i), t or "") for i, t, _ in rows if not (t or "").startswith(item))
    hidden = stage["pii"](spark, docs, str(tmp_path))
    assert hidden.columns == docs.columns and hidden.count() == len(rows)
    assert {r.doc_id for r in stage["packing"](spark, docs, str(tmp_path)).collect()} == {i for i, _, _ in rows}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
