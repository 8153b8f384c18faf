"""Training-order materialisation: fixed-stride shards in an order given by a keyed permutation.

Every document gives ceil(tokens / length) sequences and reserves one number for each that its bytes could give, so numbers need no
tokens: documents are counted in the order of their files and rows, whatever splits they are read in. A Feistel network over the smallest even-bit domain that holds
all numbers, walked until it lands inside, maps numbers one to one to places; a place's range is its shard. Shards are
written in the order of places, each sequence at index * stride, and a sequence's global slot is its shard's first slot plus its
index: dense, one to one, and known to a reader from the shards' counts alone, so a reader seeks to any step and
resumes there. Texts are tokenised once and no row is ranked by a global sort. (A slot is thus the rank of a Feistel value among those in use,
not the value itself: that needs the number of sequences before any is sent, which costs either all tokens twice or one more copy of them on disk.)
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialise
from .tokens import END, encoder

FEISTEL_ROUNDS = 6


def permute(x: np.ndarray, total: int, key: int) -> np.ndarray:
    """Slots of the numbers x in [0, total): a bijection for every key."""
    if total < 2:
        return np.zeros_like(x, dtype=np.int64)
    half = np.uint64(max(1, ((total - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(FEISTEL_ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & low
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & low)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while True:  # cycle walking; the domain is under four times total
        far = np.flatnonzero(out >= np.uint64(total))
        if not len(far):
            return out.astype(np.int64)
        out[far] = once(out[far])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Shards that the driver lists, about, and sequences of one: up to a gigabyte of two-byte ids at the default length.
SHARDS, LEAST, MOST = 4096, 4096, 1 << 20


def _in_order(documents: DataFrame) -> DataFrame:
    """doc_id, text, and file and row, an order that doesn't depend on splits where the rows come straight from files; otherwise that of the partitions."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    try:
        return documents.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # rows that were computed know no file
        return documents.select(*columns, F.format_string("%012d", F.spark_partition_id()).alias("file"), F.monotonically_increasing_id().alias("row"))


def write_shards(documents: DataFrame, path: str, length: int = 512, per_shard: int | None = None, key: int = 17, vocabulary: str | None = None) -> DataFrame:
    """documents (doc_id, text) -> files under path (a URI that pyarrow reaches from every executor), and per sequence
    doc_id, part, slot, shard, byte_offset, n_tokens, crc32 (of the stride's bytes as written).

    A sequence takes length ids of two bytes, little endian (four if the vocabulary needs them); its last one in a document is filled
    with the end id. Null and empty texts give one sequence of end ids. Repeated rows are sequences of their own. An empty table gives no shards.
    A shard holds at most per_shard sequences (by default so many that there are about SHARDS of them, from LEAST to MOST each, so what the driver lists stays short) and appears under its name only when complete (written aside, then moved), so tasks may
    fail or run twice; manifest.json comes last, when all shards stand.
    """
    spark = documents.sparkSession
    docs = _in_order(documents)
    kind = "<u2" if encoder(vocabulary).size <= 1 << 16 else "<u4"
    stride = length * np.dtype(kind).itemsize

    # a byte gives one token at most, and the end id follows; one row per split and file, so their number is bounded by those of tasks and files
    most = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / length).cast("long") + 1
    parts = docs.groupBy(F.spark_partition_id().alias("split"), "file").agg(F.min("row").alias("row"), F.sum(most).alias("n")).collect()
    total, base = 0, {}
    for r in sorted(parts, key=lambda r: (r.file, r.row)):
        base[r.split, r.file], total = (total, r.n), total + r.n
    sent = spark.sparkContext.broadcast(base)
    per_shard = per_shard or min(MOST, max(LEAST, -(-total // SHARDS)))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        file, first, reserved = None, 0, 0

        def close() -> None:
            if file is not None and reserved != sent.value[split, file][1]:
                raise RuntimeError(f"split {split} of {file} reserves {reserved} numbers, {sent.value[split, file][1]} when counted: the input changed in between")

        for b in batches:
            docs_, sizes, numbers, flat = [], [], [], []

            def out() -> pa.RecordBatch:
                n = np.array(sizes, np.int64)
                each = -(-n // length)
                rows = int(each.sum())
                part = np.arange(rows) - np.repeat(np.cumsum(each) - each, each)
                raw = pa.py_buffer(np.array(flat, kind))
                ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * stride, stride, dtype=np.int32)), raw])
                places = permute(np.repeat(np.array(numbers, np.int64), each) + part, total, key)
                doc = pa.array(docs_, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), each)))
                used = np.minimum(length, np.repeat(n, each) - part * length)
                return batch({"doc_id": doc, "part": pa.array(part.astype(np.int32)), "place": pa.array(places), "n_tokens": pa.array(used.astype(np.int32)), "ids": ids})

            for doc, text, from_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if from_ != file:
                    close()
                    file, first, reserved = from_, sent.value[split, from_][0], 0
                text = text or ""
                ids = enc.ids(text)
                flat += ids
                flat += [END] * (length - len(ids) % length)
                docs_.append(doc), sizes.append(len(ids) + 1), numbers.append(first + reserved)
                reserved += len(text.encode()) // length + 1
                if len(flat) >= 1 << 20:
                    yield out()
                    docs_, sizes, numbers, flat = [], [], [], []
            yield out()
        close()

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(path)
        attempt = TaskContext.get().taskAttemptId()
        shard, file, tmp, at = None, None, "", 0

        def close() -> None:
            if file is not None:
                file.close()
                filesystem.move(tmp, f"{root}/shard-{shard:08d}.bin")

        for b in rows:
            of = b.column(2).to_numpy() // per_shard
            column = b.column(4)
            raw = memoryview(column.buffers()[2])[np.frombuffer(column.buffers()[1], np.int32)[column.offset] :] if b.num_rows else memoryview(b"")
            index = np.zeros(b.num_rows, np.int64)
            for s in np.unique(of).tolist():
                if s != shard:
                    close()
                    shard, at = s, 0
                    tmp = f"{root}/.attempt-{attempt}-{s:08d}"
                    file = filesystem.open_output_stream(tmp)
                # places ascend, so a shard's rows are neighbours and so are their bytes
                lo, hi = np.searchsorted(of, [s, s + 1]).tolist()
                file.write(raw[lo * stride : hi * stride])
                index[lo:hi] = np.arange(at, at + hi - lo)
                at += hi - lo
            crc = [zlib.crc32(raw[i * stride : (i + 1) * stride]) for i in range(b.num_rows)]
            yield batch({"doc_id": b.column(0), "part": b.column(1), "shard": pa.array(of), "index": pa.array(index), "n_tokens": b.column(3), "crc32": pa.array(crc, pa.int64())})
        close()

    filesystem, root = _filesystem(path)
    filesystem.create_dir(root, recursive=True)
    made = docs.select("doc_id", "text", "file").mapInArrow(sequences, "doc_id long, part int, place long, n_tokens int, ids binary")
    # a task gets neighbouring ranges of places, whole ones; places are a random order, so ranges are even
    ranges = -(-total // per_shard)
    tasks = max(1, min(ranges, 4 * spark.sparkContext.defaultParallelism + ranges // 16))
    dealt = made.repartitionById(tasks, F.floor(F.floor(F.col("place") / per_shard) * tasks / max(1, ranges)).cast("int"))
    dealt = dealt.sortWithinPartitions("place").select("doc_id", "part", "place", "n_tokens", "ids")
    report = materialise(dealt.mapInArrow(write, "doc_id long, part int, shard long, index long, n_tokens int, crc32 long"), "sequences")
    counts = sorted(report.groupBy("shard").count().collect())  # one row per shard
    starts, at = {}, 0
    for r in counts:
        starts[r.shard], at = at, at + r["count"]
    manifest = {"sequences": at, "length": length, "stride": stride, "dtype": kind, "key": key, "end": END, "shards": [[r.shard, r["count"]] for r in counts]}
    with filesystem.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    from pyarrow import fs

    for left in filesystem.get_file_info(fs.FileSelector(root)):  # of tasks that failed or ran twice
        if left.base_name.startswith(".attempt-"):
            filesystem.delete_file(left.path)
    first = spark.createDataFrame(list(starts.items()), "shard long, first long")
    out = report.join(F.broadcast(first) if len(starts) <= 1_000_000 else first, "shard")
    return out.select("doc_id", "part", (F.col("first") + F.col("index")).alias("slot"), "shard", (F.col("index") * stride).alias("byte_offset"), "n_tokens", "crc32")


def read_slots(path: str, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences of the slots first .. first + count - 1, in order: the resume point is just a slot."""
    filesystem, root = _filesystem(path)
    with filesystem.open_input_file(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    numbers, counts = [x for x, _ in m["shards"]], np.cumsum([0, *(n for _, n in m["shards"])])
    slot, end = first, min(first + count, m["sequences"])
    while slot < end:
        k = int(np.searchsorted(counts, slot, side="right")) - 1
        with filesystem.open_input_file(f"{root}/shard-{numbers[k]:08d}.bin") as f:
            f.seek(int(slot - counts[k]) * m["stride"])
            for _ in range(int(min(end, counts[k + 1]) - slot)):
                yield np.frombuffer(f.read(m["stride"]), m["dtype"])
        slot = int(min(end, counts[k + 1]))
