import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import pack, pack_sizes, pieces
from lodestone.llm.token_output import permute, read_slots, write_shards
from lodestone.llm.tokens import END, default_vocabulary, encoder

REFERENCE = Tokenizer.from_file(default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizers_library(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert encoder().ids(text) == ids
    assert encoder().text(ids) == text


def test_ids_of_odd_texts():
    assert encoder().ids("<|endoftext|>") == [50256] and encoder().text([50256]) == "<|endoftext|>"
    for t in ("", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n b <|endof", "don't I'LL we've", " " * 300 + "\t\n", "a" * 20000, "日本語 😀 é́"):
        assert encoder().ids(t) == REFERENCE.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_bins_hold_every_item_once_and_no_more_than_fits(sizes):
    s = np.array(sizes, np.int64)
    bins = pack_sizes(s, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(s[b].sum() <= 64 for b in bins)
    assert sorted(sorted(sizes[i] for i in b) for b in bins) == sorted(by_the_rule(sizes, 64))


def by_the_rule(sizes, capacity):
    """The sum itself, tried for every gap that has room; of bins with one gap, the one that came to it last."""
    bins = []
    for s in sorted(sizes, reverse=True):
        best = None
        for gap in sorted({capacity - sum(b) for b in bins} - {0}):
            if gap >= s:
                gaps = [g for b in bins if (g := capacity - sum(b))]
                gaps.remove(gap)
                gaps += [gap - s] * (gap > s)
                total = sum(gaps.count(g) ** 2 for g in set(gaps))
                if best is None or total < best[0]:
                    best = total, gap
        if best is None:
            bins.append([s])
        else:
            own = next(b for b in reversed(bins) if capacity - sum(b) == best[1])
            bins = [b for b in bins if b is not own] + [own]
            own.append(s)
    return [sorted(b) for b in bins]


def test_pieces_and_places(spark):
    rows = [(1, "a b c " * 900), (2, None), (3, ""), (4, "short text"), (4, "short text"), (None, "no id"), (5, "x" * 40000)]
    d = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, offset int")
    got = pack(d, capacity=256, group=4).collect()
    want = []
    for i, t in rows:
        ids = np.array([*REFERENCE.encode(t or "", add_special_tokens=False).ids, END], "<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at - 1) % 256 + 1
            want.append((str(i), k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, k = at + n, k + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pieces(d, 256, with_ids=True).count() == len(want)


def test_sequences_come_close_to_the_least_possible(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 6000)
    assert len(pack_sizes(sizes, 1024)) <= 1.004 * np.ceil(sizes.sum() / 1024)


def test_groups_of_equal_rows_are_split(spark):
    d = spark.createDataFrame([(None, "")] * 2000, "doc_id long, text string")
    got = [r.sequence_id >> 32 for r in pack(d, group=100).collect()]
    assert len(got) == 2000 and max(got.count(g) for g in set(got)) < 200


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**63))
def test_permutation_is_one_to_one(total, key):
    assert sorted(permute(np.arange(total), total, key).tolist()) == list(range(total))


def test_shards_round_trip_and_resume(spark, tmp_path):
    rows = [(i, "word " * (i % 40) + str(i)) for i in range(300)] + [(900, None), (901, ""), (7, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    got = write_shards(d, str(tmp_path / "s"), length=16, per_shard=50).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    stored = list(read_slots(str(tmp_path / "s"), 0, n))
    assert all(zlib.crc32(stored[r.slot].tobytes()) == r.crc32 for r in got)
    assert [x.tolist() for x in read_slots(str(tmp_path / "s"), 117, 60)] == [x.tolist() for x in stored[117:177]]
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part, stored[r.slot][: r.n_tokens].tolist()))
    for i, t in rows:
        if i != 7:
            assert sum((x for _, x in sorted(parts[i])), []) == [*encoder().ids(t or ""), END]
    again = write_shards(d, str(tmp_path / "t"), length=16, per_shard=50, key=18).collect()
    assert sorted((r.doc_id, r.part) for r in again) == sorted((r.doc_id, r.part) for r in got)
    assert [r.slot for r in sorted(again, key=lambda r: (r.doc_id, r.part))] != [r.slot for r in sorted(got, key=lambda r: (r.doc_id, r.part))]


def test_the_order_is_that_of_files_and_rows_whatever_the_splits(spark, tmp_path):
    rows = [(i if i % 50 else None, "word " * (i % 30) + str(i), "clash", i) for i in range(400)] + [(1000, "long " * 40000, "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, file string, row long").repartition(3).write.option("parquet.block.size", "1024").parquet(str(tmp_path / "in"))
    got = []
    for k, size in enumerate(("128m", "4k")):
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            made = write_shards(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / f"o{k}"), length=16, per_shard=50)
            got.append(sorted((str(r.doc_id), r.part, r.slot, r.shard, r.crc32) for r in made.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got[0] == got[1] and sorted(x[2] for x in got[0]) == list(range(len(got[0])))


def test_no_rows_no_shards(spark, tmp_path):
    assert write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e")).collect() == []
