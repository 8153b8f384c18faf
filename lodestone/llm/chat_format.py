"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A node stands for one turn after one history; its key is a polynomial over the digests of the turns up to it, which can be summed
range by range: rows are sorted by conversation and turn in ranges that may cut a conversation anywhere, each range is summed by itself,
and a few numbers per range carry the sums on. So no task gathers a conversation, however long, and no text moves for it.
A node belongs to the smallest conversation through it, so each conversation owns the end of its own path, a chain, which hangs on a
node of another's chain. Depth first, a chain comes whole, then the chains that hang on it, deepest first: an order that
needs one short key per chain, with one step per branch. Nodes get their places in one global token stream by
a running sum over ranges in that order, so no task holds a level or all children of a turn. As chains lie whole in the
stream, a node's ancestors are one interval per branch: a node carries the position of its first token in its conversation and these
intervals, neighbouring ones merged, which with its own tokens are all that it may attend to.

Texts move apart from all this, by the digest of their turn: each distinct turn is tokenised once and joined to its nodes at the end.

Format of a turn: `<s>` before the first, `[ROLE]` for other roles than user and assistant, `[INST] ` text ` [/INST]` for a user,
`[ANSWER] ` text ` </s>` for an assistant. Every control string begins with `<` or `[`; in texts these are written `\\l` and `\\b`, and a
backslash twice, so no text holds a control string, whatever it says, and reading back restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PER_SALT, batch, fan_join, kept, materialise
from .tokens import encoder

#: Stands for a null conv_id inside.
NO_ID = -(1 << 63)
#: Keys are polynomials over turn digests in this field, at this base.
PRIME, BASE = (1 << 127) - 1, int.from_bytes(hashlib.sha256(b"turns").digest()[:15], "big")
#: Bytes of text that a Python worker turns into objects at once.
SLICE = 2 << 20

def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\([lb\\])", lambda m: {"l": "<", "b": "[", "\\": "\\"}[m[1]], text)


def segments(role: str, text: str, first: bool) -> tuple[str, str, str]:
    """(before, escaped text, after) of a turn; only an assistant's text is learned from."""
    start = "<s>" if first else ""
    body = escape(text)
    if role == "user":
        return start + "[INST] ", body, " [/INST]"
    if role == "assistant":
        return start + "[ANSWER] ", body, " </s>"
    return f"{start}[ROLE {escape(role)} ROLE] ", body, " [/ROLE]"


def parse(before: str, body: str) -> tuple[str, str]:
    """(role, text) from a turn's segments as read back."""
    before = before.removeprefix("<s>")
    if before == "[INST] ":
        return "user", unescape(body)
    if before == "[ANSWER] ":
        return "assistant", unescape(body)
    return unescape(before.removeprefix("[ROLE ").removesuffix(" ROLE] ")), unescape(body)


def _part(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about SLICE bytes of a string or binary column, so what Python holds doesn't follow the rows' length."""
    for b in batches:
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0), dtype=np.int64) + 64)
        a = 0
        while a < b.num_rows:
            end = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE, side="right")))
            yield b.slice(a, end - a)
            a = end


def _local_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, digest, ...) of one sorted range -> with pos (rows of the conversation in this range so far) and the sum over them."""
    conv, pos, key = None, 0, 0
    for b in batches:
        at, keys = [], []
        for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != conv:
                conv, pos, key = c, 0, 0
            pos, key = pos + 1, (key * BASE + int.from_bytes(d, "big")) % PRIME
            at.append(pos), keys.append(key.to_bytes(16, "big"))
        yield batch({"range": b.column(2), "conv_id": b.column(0), "pos": pa.array(at, pa.int64()), "key": pa.array(keys, pa.binary()), "digest": b.column(1)})


def _refs(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, tie, digest) -> (conv_id, depth, key, digest): each turn's place in its conversation and its node."""
    parts = max(1, turns.sparkSession.sparkContext.defaultParallelism, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = turns.repartitionByRange(parts, "conv_id", "turn", "role", "tie", "digest").sortWithinPartitions("conv_id", "turn", "role", "tie", "digest")
    dealt = dealt.select("conv_id", "digest", F.spark_partition_id().alias("range"))
    local = materialise(dealt.mapInArrow(_local_keys, "range int, conv_id long, pos long, key binary, digest binary"), "turns")
    # a range's first conversation may have begun before; the numbers that carry it on are one small row per range
    ends = local.groupBy("range").agg(F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", "pos", "key"), F.struct("conv_id", "pos")).alias("last"))
    carry, conv, depth, key = {}, None, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        if r["first"] == conv:
            carry[r["range"]] = (conv, depth, key)
        whole = r["first"] == r["last"]["conv_id"] == conv
        own, n = int.from_bytes(r["last"]["key"], "big"), r["last"]["pos"]
        depth, key = (depth + n, (key * pow(BASE, n, PRIME) + own) % PRIME) if whole else (n, own)
        conv = r["last"]["conv_id"]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depths, keys = [], []
            for r, c, pos, k in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                before = carry.get(r)
                d = pos - 1
                if before and before[0] == c:
                    k = ((before[2] * pow(BASE, pos, PRIME) + int.from_bytes(k, "big")) % PRIME).to_bytes(16, "big")
                    d += before[1]
                depths.append(d), keys.append(k)
            yield batch({"conv_id": b.column(1), "depth": pa.array(depths, pa.int64()), "key": pa.array(keys, pa.binary()), "digest": b.column(4)})

    return local.mapInArrow(carried, "conv_id long, depth long, key binary, digest binary")


def _contents(vocabulary: str | None):
    """Distinct turns (digest, role, text) -> digest, role, ids of the text, n tokens in all and how many more at the start of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in _part(batches, 2):
            body, n, extra = [], [], []
            for role, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                before, escaped, after = segments(role, text, False)
                ids, fixed = enc.array(escaped).astype("<u4"), len(enc.ids(before))
                body.append(ids.tobytes()), n.append(fixed + len(ids) + len(enc.ids(after))), extra.append(len(enc.ids("<s>" + before)) - fixed)
            yield batch({"digest": b.column(0), "role": b.column(1), "body": pa.array(body, pa.binary()), "n": pa.array(n, pa.int64()), "extra": pa.array(extra, pa.int64())})

    return run


def _placed(ordered: DataFrame) -> DataFrame:
    """ordered (key, owner, n, range, ...), sorted by chain and depth within ranges that may cut a chain, gets stream_start and chain_start."""
    sums = ordered.groupBy("range").agg(F.sum("n").alias("n"), F.min_by("owner", "rank").alias("first"), F.max_by("owner", "rank").alias("last"), F.max_by("since", "rank").alias("since"))
    base, chain, at = {}, {}, 0
    begun: tuple = (None, 0)
    for r in sorted(sums.collect(), key=lambda r: r["range"]):  # as many rows as ranges
        base[r["range"]] = at
        if r["first"] == begun[0]:
            chain[r["range"]] = begun
        if not (r["first"] == r["last"] == begun[0]):
            begun = (r["last"], at + r["since"])
        at += r["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges, owners, at = (b.column(i).to_numpy() for i in (0, 1, 2))
            first = np.array([base[r] for r in ranges.tolist()], np.int64)
            start = first + b.column(3).to_numpy()
            for r in np.unique(ranges).tolist():
                if r in chain:
                    start[(ranges == r) & (owners == chain[r][0])] = chain[r][1]
            yield batch({"key": b.column(4), "owner": b.column(1), "depth": b.column(5), "digest": b.column(6), "convs": b.column(7), "own": b.column(8), "n": b.column(9), "chain_start": pa.array(start), "stream_start": pa.array(first + at)})

    kept = ordered.select("range", "owner", "at", "since", "key", "depth", "digest", "convs", "own", "n")
    return kept.mapInArrow(place, "key binary, owner long, depth long, digest binary, convs long, own long, n long, chain_start long, stream_start long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, owner, n, ...) of one sorted range -> with rank, at (tokens before in this range) and since (those before its chain's first row here)."""
    rank, at, owner, since = 0, 0, None, 0
    for b in batches:
        out: list[list] = [[], [], []]
        for o, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if o != owner:
                owner, since = o, at
            for column, v in zip(out, (rank, at, since), strict=True):
                column.append(v)
            rank, at = rank + 1, at + n
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in out)], names=[*b.schema.names, "rank", "at", "since"])


def prefix_tree(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) -> (nodes, refs).

    nodes: key, depth, convs (conversations through it), ids (binary uint32 tokens), n, stream_start (of its tokens in the depth-first stream),
    position_start (of its first token in its conversation), attends (array of struct<start, end> of its ancestors' tokens in the stream, root first, adjacent ones as one),
    text_from and text_to (its text's tokens within ids), learn (true where that text is under the loss mask).
    refs: conv_id, depth, key. Null texts and roles are empty; turns that repeat a number stand in the order of role, then of their texts' first
    32 characters, then of their digests; rows with a null conv_id are one conversation. Extra columns are not read; no rows give no nodes.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the role's length stands before it, so no other turn has the same bytes
    rows = rows.withColumn("digest", F.unhex(F.substring(F.sha2(F.concat_ws("", F.length("role"), F.lit(":"), "role", "text"), 256), 1, 30)))
    refs = kept(spark, "refs", lambda: _refs(rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("tie"), "digest")))
    tree = kept(spark, "tree", lambda: _tree(rows, refs, vocabulary))
    return tree, refs.select(F.when(F.col("conv_id") != NO_ID, F.col("conv_id")).alias("conv_id"), "depth", "key")


def _tree(rows: DataFrame, refs: DataFrame, vocabulary: str | None) -> DataFrame:
    """The nodes of prefix_tree() from rows (digest, role, text) and refs."""
    spark = rows.sparkSession
    owners = materialise(refs.groupBy("key").agg(F.min("conv_id").alias("owner"), F.count("*").alias("convs"), F.first("depth").alias("depth"), F.first("digest").alias("digest")), "owners")
    # a branch of a conversation's path: nodes of one owner, always an unbroken run
    found = fan_join(refs.select("conv_id", "key", "depth"), owners.select("key", "owner", "convs"), ["key"], "convs", "conv_id")
    branches = materialise(found.groupBy("conv_id", "owner").agg(F.min("depth").alias("from"), F.max("depth").alias("to"), F.count("*").alias("own")), "branches")
    chains = branches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("from", "owner"))).alias("path"), F.max(F.when(F.col("owner") == F.col("conv_id"), F.col("own"))).alias("own")).where("own is not null")
    chains = materialise(chains.select(F.col("conv_id").alias("owner"), F.transform("path", lambda x: F.struct((-x["from"]).alias("up"), x["owner"].alias("owner"))).alias("chain"), "own"), "chains")
    turns = rows.select("digest", "role", "text").dropDuplicates(["digest"])  # first within each task, so a turn that very many say is sent a few times
    contents = materialise(turns.mapInArrow(_contents(vocabulary), "digest binary, role string, body binary, n long, extra long"), "contents")
    many = owners.groupBy("digest").agg(F.count("*").alias("nodes"))
    sizes = contents.select("digest", "n", "extra").join(many, "digest")
    nodes = fan_join(owners, sizes, ["digest"], "nodes", "key").withColumn("n", F.col("n") + F.when(F.col("depth") == 0, F.col("extra")).otherwise(0)).drop("extra")
    nodes = fan_join(nodes, chains.withColumn("asked", F.col("own")), ["owner"], "asked", "key")
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = nodes.repartitionByRange(parts, "chain", "depth").sortWithinPartitions("chain", "depth").select(F.spark_partition_id().alias("range"), "owner", "n", "key", "depth", "digest", "convs", "own")
    ordered = materialise(ordered.mapInArrow(_running, "range int, owner long, n long, key binary, depth long, digest binary, convs long, own long, rank long, at long, since long"), "order")
    placed = materialise(_placed(ordered), "placed")
    # the tokens of a branch in its owner's chain, up to the node where the next branch hangs
    asked = branches.where("conv_id <> owner").join(chains.select(F.col("owner").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "owner", F.col("from"), F.col("to").alias("depth"))
    ends = placed.select("owner", "depth", "convs", "chain_start", (F.col("stream_start") + F.col("n")).alias("end"))
    spans = fan_join(asked, ends, ["owner", "depth"], "convs", "conv_id")
    above = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("from", F.col("chain_start").alias("start"), "end"))).alias("above"))
    above = chains.select(F.col("owner").alias("conv_id"), "own").join(above, "conv_id", "left").select(F.col("conv_id").alias("owner"), "own", F.coalesce("above", F.expr("cast(array() as array<struct<from:bigint,start:bigint,end:bigint>>)")).alias("above"))
    known = fan_join(placed.drop("own"), above, ["owner"], "own", "key")
    span = "struct<start:bigint,end:bigint>"
    every = f"filter(concat(transform(above, x -> struct(x.start as start, x.end as end)), array(struct(chain_start as start, stream_start as end))), x -> x.end > x.start)"
    merged = f"""aggregate({every}, cast(array() as array<{span}>), (a, x) -> if(size(a) > 0 and element_at(a, -1).end = x.start,
        concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, x.end as end))), concat(a, array(x))))"""
    known = known.withColumn("attends", F.expr(merged)).withColumn("position_start", F.expr("aggregate(attends, 0L, (a, x) -> a + x.end - x.start)"))
    known = known.select("digest", "key", "depth", "convs", "n", "stream_start", "position_start", "attends")
    full = fan_join(known, contents.select("digest", "role", "body").join(many, "digest"), ["digest"], "nodes", "key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, edges = encoder(vocabulary), {}
        for b in _part(batches, 1):
            ids, lo, hi, learn = [], [], [], []
            for body, role, depth in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if (role, depth == 0) not in edges:
                    before, _, after = segments(role, "", depth == 0)
                    edges = {k: v for k, v in edges.items() if len(edges) < 64} | {(role, depth == 0): tuple(enc.array(x).astype("<u4").tobytes() for x in (before, after))}
                before, after = edges[role, depth == 0]
                ids.append(before + body + after), lo.append(len(before) // 4), hi.append((len(before) + len(body)) // 4), learn.append(role == "assistant")
            yield batch({"key": b.column(0), "depth": b.column(3), "convs": b.column(4), "ids": pa.array(ids, pa.binary()), "n": b.column(5), "stream_start": b.column(6), "position_start": b.column(7), "attends": b.column(8), "text_from": pa.array(lo, pa.int32()), "text_to": pa.array(hi, pa.int32()), "learn": pa.array(learn, pa.bool_())})

    schema = "key binary, depth long, convs long, ids binary, n long, stream_start long, position_start long, attends array<struct<start:long,end:long>>, text_from int, text_to int, learn boolean"
    return full.select("key", "body", "role", "depth", "convs", "n", "stream_start", "position_start", "attends").mapInArrow(write, schema)


def read_back(nodes: DataFrame, refs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """prefix_tree() -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the tokens of the output.

    Turns reach a task sorted by conversation and depth and are digested as they come, so a conversation is never held, however long it is."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in _part(batches, 1):
            role, text, chars = [], [], []
            for ids, lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(ids, "<u4")
                parts = [enc.text(p) for p in (x[:lo], x[lo:hi], x[hi:])]
                r, t = parse(parts[0], parts[1])
                role.append(r), text.append(t), chars.append(sum(map(len, parts)))
            yield batch({"key": b.column(0), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "chars": pa.array(chars, pa.int64()), "learn": b.column(4), "convs": b.column(5)})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, chars, loss_chars, all_, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out: list[list] = [[] for _ in kinds]

        def close() -> None:
            if n:
                for column, v in zip(out, (None if conv == NO_ID else conv, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                    column.append(v)

        def made() -> pa.RecordBatch:
            return batch({x: pa.array(c, t) for x, c, t in zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), out, kinds, strict=True)})

        for b in _part(batches, 2):
            for c, role, text, size, learn in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv or not n:
                    close()
                    conv, n, chars, loss_chars, all_, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, chars = n + 1, chars + size
                all_.update(f"{role}\n{text}\n".encode())
                if learn:
                    loss.update(text.encode())
                    loss_chars += len(text)
            yield made()
            out = [[] for _ in kinds]
        close()
        yield made()

    said = nodes.select("key", "ids", "text_from", "text_to", "learn", "convs").mapInArrow(decode, "key binary, role string, text string, chars long, learn boolean, convs long")
    ask = refs.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id"), "depth", "key")
    wide = nodes.select("key", F.ceil(F.col("convs") / PER_SALT).cast("int").alias("salts")).where("salts > 1")
    ask = ask.join(F.broadcast(wide) if wide.count() < 100_000 else wide, "key", "left").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    dealt = said.withColumn("salt", F.explode(F.expr(f"sequence(0, greatest(1, cast(ceil(convs / {PER_SALT}) as int)) - 1)"))).drop("convs")
    turns = ask.join(dealt, ["key", "salt"]).select("conv_id", "role", "text", "chars", "learn", "depth").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return turns.select("conv_id", "role", "text", "chars", "learn").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
