import importlib.util

import pytest

import __spark_entry__ as entry
from lodestone.sources import io
from lodestone.streaming.journal import ingest, read_journal


def test_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k long").count() == 2
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        io.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k long").collect()


def test_empty_cells_are_null(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    io.write_csv(df, str(tmp_path / "t"), ["k", "v"])
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "t"), "k string, v double").collect())) == [("a", None), ("b", 1.5)]
    with pytest.raises(Exception, match="exists"):
        io.write_csv(df, str(tmp_path / "t"), ["k", "v"])
    with pytest.raises(ValueError, match="not fields: v"):
        io.write_csv(df, str(tmp_path / "u"), ["k"])


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    io.publish({"a": spark.range(3), "b": spark.range(2)}, path, {"x": 1})
    assert spark.read.parquet(f"{path}/a").count() == 3 and (tmp_path / "p" / "manifest.json").read_text() == '{"x": 1}'
    with pytest.raises(FileExistsError):
        io.publish({"a": spark.range(3)}, path, {})


def test_pages_of_binary_files(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"first\fsecond\f ")
    (tmp_path / "two.bin").write_bytes(b"\xff")
    got = sorted(map(tuple, io.pages_from_binary(spark, str(tmp_path), lambda c: c.decode().split("\f")).collect()), key=str)
    assert got[:3] == [("one", 0, "first", "ok"), ("one", 1, "second", "ok"), ("one", 2, " ", "empty")] and got[3][3].startswith("error:UnicodeDecodeError")


def test_html_text(spark):
    d = spark.createDataFrame([("<html><head><title>x</title></head><body><p>a &amp; <b>b</b></p><script>no</script><div>c</div></body>",), (None,)], "html string")
    assert [r.text for r in io.html_to_text(d).collect()] == ["a & b\nc", None]
    odd = {
        "": "", "plain": "plain", "<p>a<p>b": "a\nb", "a<br/>b<BR>c": "a\nb\nc", "<div\n class='x'>a</div >b": "a\nb", "<pre>x</pre>": "x", "<header>h</header><head>no</head>t": "h\nt", "<b>a</b><i>b</i>": "ab",
        "a<!-- <p>no</p> -->b": "ab", "a<!-- open": "a", "a<script>x<b>y": "a", "<STYLE type=t>p{}</style >z": "z", "1 < 2 & 3 > 2": "1 < 2 & 3 > 2", "x<p": "x", "x &am": "x &am",
        "&lt;p&gt; &#65;&#x42;&#X1F600; &#0;&#55296;&#9999999; &nope; &amp;lt; &copy; &nbsp;x&nbsp;": "<p> AB\U0001f600 \ufffd\ufffd\ufffd &nope; &lt; \u00a9 x", " a \t\n b\u2003c ": "a b c",
    }
    d = spark.createDataFrame([(k,) for k in odd], "html string")
    assert [r.text for r in io.html_to_text(d).collect()] == list(odd.values())
    many = "<div>" * 3000 + "x &amp; y<br>" * 3000
    assert io.html_to_text(spark.createDataFrame([(many,)], "html string")).first().text == "\n".join(["x & y"] * 3000)


def test_html_text_against_a_walk_over_characters(spark):
    """Random pages of tags, references and text, against a scanner that reads one character after the other."""
    import random

    rng = random.Random(3)
    parts = ["<p>", "</p>", "<b class='x'>", "</b>", "<br/>", "text", " ", "\n", "&amp;", "&#233;", "&x;", "<!-- c -->", "<script>s</script>", "<td>", "é", "&", "a < ", "1>0"]
    pages = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]

    def walk(page):
        out, i = [], 0
        while i < len(page):
            if page.startswith("<!--", i):
                end = page.find("-->", i)
                i = len(page) if end < 0 else end + 3
            elif page.startswith("<script>", i):
                end = page.find("</script>", i)
                i = len(page) if end < 0 else end + 9
            elif page[i] == "<" and i + 1 < len(page) and (page[i + 1] in "!/?" or page[i + 1].isascii() and page[i + 1].isalpha()):
                end = page.find(">", i)
                name = page[i + 1 : end if end >= 0 else len(page)].strip("/").split(" ")[0]
                out += ["\n"] * (name in ("p", "br", "td"))
                i = len(page) if end < 0 else end + 1
            elif page.startswith("&amp;", i):
                out.append("&")
                i += 5
            elif page.startswith("&#233;", i):
                out.append("é")
                i += 6
            else:
                out.append(" " if page[i] == "\n" else page[i])
                i += 1
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    assert [r.text for r in io.html_to_text(spark.createDataFrame([(p,) for p in pages], "html string")).collect()] == list(map(walk, pages))


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    io.write_json(spark, {"a": 1}, path)
    with pytest.raises(FileExistsError):
        io.write_json(spark, {"a": 2}, path)
    io.write_json(spark, {"a": 3}, path, replace=True)
    assert io.read_json(spark, path) == {"a": 3} and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_stream_takes_each_key_once(spark, tmp_path):
    work = lambda: ingest(spark, str(tmp_path / "in"), "k long, v string", ["k"], lambda df: df, str(tmp_path / "journal"), str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k long, v string").write.json(str(tmp_path / "in"))
    work()
    spark.createDataFrame([(2, "again"), (3, "c")], "k long, v string").write.mode("append").json(str(tmp_path / "in"))
    work()
    journal = lambda: sorted(map(tuple, read_journal(spark, str(tmp_path / "journal")).collect()))
    assert journal() == [(1, "a"), (2, "b"), (3, "c")]
    # a checkpoint that is gone: the whole input is read again, and what the journal has is left out
    ingest(spark, str(tmp_path / "in"), "k long, v string", ["k"], lambda df: df, str(tmp_path / "journal"), str(tmp_path / "state2")).awaitTermination()
    assert journal() == [(1, "a"), (2, "b"), (3, "c")]


def test_a_run_killed_midway_resumes_without_a_repeat(spark, tmp_path):
    """The second of three batches dies after a part of it has been written; the next start writes it anew."""
    at = lambda x: str(tmp_path / x)
    for k in range(3):
        spark.createDataFrame([(10 * k + j, f"v{j}") for j in range(4)] + [(0, "again")], "k long, v string").coalesce(1).write.mode("append").json(at("in"))
    seen = []

    def dies(df):
        seen.append(df.count())
        if len(seen) == 2:
            run = next(p.name for p in (tmp_path / "journal").iterdir() if p.name.startswith("run="))
            df.limit(2).write.parquet(f"{at('journal')}/{run}/batch=1")
            raise RuntimeError("killed")
        return df

    start = lambda work: ingest(spark, at("in"), "k long, v string", ["k"], work, at("journal"), at("state"), files=1)
    with pytest.raises(Exception, match="killed"):
        start(dies).awaitTermination()
    start(lambda df: df).awaitTermination()
    got = [r.k for r in read_journal(spark, at("journal")).collect()]
    assert sorted(got) == sorted(10 * k + j for k in range(3) for j in range(4))


def test_entry_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "bm25_topk" in names
    if importlib.util.find_spec("lodestone.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names


def test_whole_tables_are_processed(spark, tmp_path):
    keys = [1, 7, 299, 300, 499, 500, 1999, 2000, 2003, 70011, 4_000_000_013]
    names = [f"NATION_{i}" for i in range(25)]
    spark.createDataFrame([(k, k % 11) for k in keys], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(n,) for n in names], "n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(k, j, 5, 3 + j, float(10 * j)) for k in keys for j in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()

    scores = {r.o_orderkey: (r.gold_numeric_count, r.generated_numeric_count, r.matched_numeric_count) for r in run("numeric_scores")}
    want = {k: (int(k % 7 > 0), int(k % 5 > 0), int(k % 7 > 0 and k % 7 == k % 5)) for k in keys}
    assert scores == want
    assert sum(r.question_count for r in run("numeric_summary")) == len(keys)

    got = {r.o_orderkey: (r.company, r.fiscal_year) for r in run("query_processing")}
    for k in keys:
        found = [n.lower().replace("_", "") for n in names if n.lower().replace("_", "") in f"nation{k % 30} in"]
        assert got.pop(k) == (found[0] if len(found) == 1 else None, 2010 + k % 12)
    assert not got

    lines = {(r.l_orderkey, r.l_linenumber): r["values"] for r in run("numeric_entities")}
    assert lines == {(k, j): [(-1 if j % 2 == 0 else 1) * 10 * j * 1e6, 3.0 + j] for k in keys for j in (1, 2)}


def test_stale_indices_are_refused(spark, tmp_path):
    from lodestone.operators import sparse
    from lodestone.sources import indices

    docs = spark.createDataFrame([(1, "apple pear"), (2, "fig")], "doc_id long, text string")
    digest = indices.corpus_digest(docs, "doc_id", "text")
    assert digest == indices.corpus_digest(docs.repartition(3), "doc_id", "text") != indices.corpus_digest(docs.where("doc_id = 1"), "doc_id", "text")
    index = sparse.build_index(docs)
    indices.save_sparse(index, str(tmp_path / "s"), digest)
    q = sparse.query_terms(spark.createDataFrame([(1, "fig")], "item_id long, text string"))
    assert sparse.search(indices.load_sparse(spark, str(tmp_path / "s"), digest), q, 2).collect() == sparse.search(index, q, 2).collect()
    with pytest.raises(ValueError, match="stale"):
        indices.load_sparse(spark, str(tmp_path / "s"), "other")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    indices.save_dense(v, str(tmp_path / "d"), digest, 2)
    assert indices.load_dense(spark, str(tmp_path / "d"), digest, dim=2).count() == 1
    with pytest.raises(ValueError, match="stale"):
        indices.load_dense(spark, str(tmp_path / "d"), dim=3)
