import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.sources import pdf
from lodestone.sources.pdf import Lexer, Operator, Pdf, read_pages, write_pdf


def opened(data):
    return Pdf(io.BytesIO(data), len(data))


def lines(t):
    return "\n".join(x.rstrip(" \t") for x in t.split("\n")).strip()


@pytest.mark.parametrize("compressed", [False, True])
def test_pages_come_back_as_they_were(compressed):
    rng = random.Random(1)
    pages = ["Hello (world) \\ x\nsecond line", "", "naïve é ñ ß € – 日本語 😀 mixed é日é", " lead\n\n\nthree   gaps \t\nend", "a" * 20000]
    pages += ["".join(rng.choices("ab ()\\<>[]/%\nééñ€日\t\x81{}#", k=rng.randint(0, 80))) for _ in range(200)]
    d = opened(write_pdf(pages, compressed))
    assert d.pages() == len(pages)
    assert [lines(d.text(k)) for k in range(len(pages))] == [lines(t) for t in pages]


def test_values_of_the_syntax():
    x = Lexer(b"<< /A#20b [1 -2.5 (a\\(b\\)\\101\\n(c)) <4a4B5> 3 0 R] /N null /T true % note\n /D << /E 7 0 R >> >> q")
    assert x.value() == {"A b": [1, -2.5, b"a(b)A\n(c)", b"JKP", (3, 0)], "N": None, "T": True, "D": {"E": (7, 0)}}
    assert x.value() == "q" and x.value() is None
    with pytest.raises(ValueError, match="string"):
        Lexer(b"(open").value()


def by_hand(bodies, trailer=b"", earlier=b""):
    """A file of objects given as text, behind an earlier one that it updates."""
    out, places = bytearray(earlier or b"%PDF-1.4\n"), {}
    for k, body in bodies.items():
        places[k] = len(out)
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(f"{k} 1\n{at:010d} 00000 n \n".encode() for k, at in places.items())
    return bytes(out) + b"trailer\n<< /Size 99 /Root 1 0 R " + trailer + f" >>\nstartxref\n{start}\n%%EOF".encode()


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(data), head) + data + b"\nendstream"


TREE = {
    1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 3/Kids[3 0 R 4 0 R]/Resources<</Font<</F 9 0 R>>>>>>", 3: b"<</Type/Pages/Count 2/Parent 2 0 R/Kids[5 0 R 6 0 R]>>",
    4: b"<</Type/Page/Parent 2 0 R/Contents[7 0 R 8 0 R]>>", 5: b"<</Type/Page/Parent 3 0 R/Contents 7 0 R>>", 6: b"<</Type/Page/Parent 3 0 R>>", 7: stream(b"BT /F 9 Tf [(Ne) -40 (t) -300 (sales)] TJ 0 -12 Td (of $5) ' (x) Tj ET"),
    8: stream(zlib.compress(b"BT 1 0 0 1 5 5 Tm (second \\050part\\051) Tj ET BI /W 1 ID \x00(\xff EI BT (third) Tj ET"), b"/Filter[/FlateDecode]"), 9: b"<</Type/Font/Subtype/Type1>>",
}


def test_trees_updates_and_operators():
    d = opened(first := by_hand(TREE))
    assert d.pages() == 3 and [lines(d.text(k)) for k in range(2)] == ["Net sales\n\nof $5x", ""]
    assert [x for x in d.text(2).split("\n") if x] == ["Net sales", "of $5x", "second (part)", "third"]
    newer = opened(by_hand({7: stream(b"BT (new) Tj ET")}, b"/Prev %d" % first.rfind(b"xref\n", 0, first.rfind(b"startxref")), first))
    assert lines(newer.text(0)) == "new"
    with pytest.raises(ValueError, match="encrypted"):
        opened(by_hand(TREE, b"/Encrypt 9 0 R"))
    with pytest.raises(ValueError, match="filter"):
        opened(by_hand(TREE | {7: stream(b"x", b"/Filter/DCTDecode")})).text(0)
    with pytest.raises(ValueError, match="no root|circle"):
        opened(by_hand({1: b"1 0 R"}).replace(b"/Root 1 0 R", b"/Info 1 0 R"))
    table = stream(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <43> <0078> <44> <45> [<00e9> <D83DDE00>] endbfrange 1 beginbfchar <46> <00660066> endbfchar")
    mapped = opened(by_hand(TREE | {9: b"<</Subtype/Type1/ToUnicode 10 0 R>>", 10: table, 7: stream(b"BT /F 1 Tf (ABCDEFG) Tj ET")}))
    assert lines(mapped.text(0)) == "xyzé😀ffG"


def test_ranges_of_pages_as_rows(spark, tmp_path):
    long = [f"page {k} of the long one" if k % 7 else "" for k in range(75)]
    damaged = write_pdf(["one", "two", "three"])
    at = damaged.find(b"stream\n", damaged.find(b"8 0 obj")) + 9
    files = {"long.pdf": write_pdf(long, True), "short one.pdf": write_pdf(["x"]), "damaged.pdf": damaged[:at] + b"\xff\xff\xff" + damaged[at + 3 :], "none.pdf": b"nothing", "cut.pdf": write_pdf(["a"])[:300], "empty.pdf": b""}
    for name, data in files.items():
        pdf.create(f"file://{tmp_path}/in/{name}", data)
    found = read_pages(spark, f"file://{tmp_path}/in", pages=8)
    rows = {(r.doc_name, r.page): (r.text, r.extraction_status) for r in found.collect()}
    assert [rows["long", k] for k in range(75)] == [(t, "ok" if t else "empty") for t in long] and rows["short one", 0] == ("x", "ok")
    assert rows["damaged", 0] == ("one", "ok") and rows["damaged", 1] == ("", "error:error") and rows["damaged", 2] == ("three", "ok")
    assert all(rows[n, None][0] is None and rows[n, None][1].startswith("error:ValueError") for n in ("none", "cut")) and len(rows) == 75 + 1 + 3 + 2
    assert not isinstance(Lexer(b"(Tj)").value(), Operator)


def test_all_pages_of_a_flat_tree_are_read_in_proportion():
    data, read = write_pdf([f"page {k} é 日" for k in range(300)]), []
    d = opened(data)
    get = d._object_at
    d._object_at = lambda at: read.append(at) or get(at)
    assert [lines(d.text(k)) for k in range(300)] == [f"page {k} é 日" for k in range(300)]
    assert len(read) < 8 * 300
    assert d.page(5)["Contents"] == opened(data).page(5)["Contents"] and lines(d.text(0)) == "page 0 é 日"
    with pytest.raises(IndexError):
        d.page(300)


def test_ranges_are_dealt_to_many_tasks(spark, tmp_path):
    pdf.create(f"file://{tmp_path}/in/a.pdf", write_pdf([f"page {k}" for k in range(64)]))
    pdf.create(f"file://{tmp_path}/in/no such.pdf", b"none")
    rows = read_pages(spark, f"file://{tmp_path}/in", pages=4).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.page, r.text) for r in rows if r.page is not None) == [(k, f"page {k}") for k in range(64)]
    assert [(r.doc_name, r.text, r.extraction_status) for r in rows if r.page is None] == [("no such", None, "error:ValueError: no cross-reference")]
    assert len({r.task for r in rows}) > 4
