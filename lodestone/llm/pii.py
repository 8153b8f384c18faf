"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

The base patterns give seed entities. A string's lexical pattern is the word that stands before it. Patterns and
the identifier-like strings they introduce form a graph that is scored in rounds. In each, the strings accepted so far (seeds, and what
earlier rounds discovered) induce patterns: a pattern is as good for a kind as the mean score of its strings, and counts if its score and support
are high; a string is as good as its patterns make it together (noisy or; seeds stay at 1) and is accepted if that is high, so it can
induce patterns of its own in the next round. Strings that no base pattern knows are taken where a good pattern introduces them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise, maybe_broadcast

KINDS = ("email", "ip", "card", "phone")
#: Equal to the base patterns, but linear in the text: possessive where no shorter match could succeed, and not tried inside a run
#: whose start has failed (\G: after the previous match).
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_DIGITS = "regexp_replace(x.x, '[^0-9]', '')"
_LUHN = f"aggregate(transform(sequence(1, length({_DIGITS})), i -> cast(substring({_DIGITS}, -i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"
CHECKS = (
    "true",
    "forall(split(x.x, '[.]'), p -> coalesce(try_cast(p as decimal(38, 0)) <= 255, length(regexp_replace(p, '^0+', '')) = 0))",
    f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    f"length({_DIGITS}) between 8 and 15",
)
#: Identifier-like: a run with a digit or an at sign.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9@._%+-]))(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]++"
#: A string that a pattern may introduce has so many digits, or an at sign inside.
LEAST_DIGITS = 5
SPAN = "array<struct<k:int,s:bigint,e:bigint,c:string,x:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _found(kind: int, pattern: str, guard: str) -> str:
    """SQL for all matches as SPAN: places in code points, the word before (c) and the string itself (x)."""
    p = _quoted(pattern)
    context = "lower(reverse(regexp_extract(reverse(z.g), r'^\\s*+(\\S++)', 1)))"  # the last word of all that stands between, in one pass from its end
    step = f"""struct(a.p + length(z.g) + length(z.h) as p, concat(a.o, array(struct({kind} as k, a.p + length(z.g) as s, a.p + length(z.g) + length(z.h) as e, {context} as c, z.h as x))) as o)"""
    return f"""if({guard}, aggregate(
        zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (h, g) -> struct(h, g)),
        cast(struct(0L as p, array() as o) as struct<p:bigint,o:{SPAN}>),
        (a, z) -> if(z.h is null, a, cast({step} as struct<p:bigint,o:{SPAN}>)), a -> a.o), cast(array() as {SPAN}))"""


def scan(documents: DataFrame, *keep: str) -> DataFrame:
    """rid, the kept columns, base (SPAN, by kind then start) and cand (SPAN of identifier-like strings that touch no base span)."""
    t = documents.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    guards = ("contains(text, '@')", "text rlike '[0-9][.][0-9]'", "text rlike '[0-9][ -]?[0-9]'", "contains(text, '+')")
    for k in range(4):
        t = t.withColumn(f"_k{k}", F.expr(_found(k, PATTERNS[k], guards[k])))
    t = t.withColumn("_cand", F.expr(_found(-1, CANDIDATE, "text rlike '[0-9@]'")))
    base = ", ".join(f"filter(_k{k}, x -> {CHECKS[k]})" for k in range(4))
    t = t.withColumn("base", F.expr(f"concat({base})"))
    fit = f"(length(regexp_replace(x.x, '[^0-9]', '')) >= {LEAST_DIGITS} or x.x rlike '[^@]@[^@]') and not exists(base, b -> b.s < x.e and x.s < b.e)"
    return t.select(F.monotonically_increasing_id().alias("rid"), *keep, "base", F.expr(f"filter(_cand, x -> {fit})").alias("cand"))


def patterns(scanned: DataFrame, rounds: int = 6, least: float = 0.8, support: int = 5) -> DataFrame:
    """scan() -> (c, k, score): contexts that introduce kind k with a score of at least `least`, resting on `support` accepted strings.
    Rounds end early when they change no pattern."""
    return kept(scanned.sparkSession, "patterns", lambda: _rounds(scanned, rounds, least, support))


def _rounds(scanned: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    rows = scanned.select(F.explode(F.concat("base", "cand")).alias("i")).select("i.c", "i.k", "i.x").where("c <> ''")
    graph = materialise(rows.groupBy("c", "x").agg(F.max("k").alias("seed")), "graph")
    size = materialise(graph.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    seeds = graph.where("seed >= 0").select("x", F.col("seed").alias("k"), F.lit(1.0).alias("w")).distinct()
    accepted, good, edges = seeds, None, graph.select("c", "x")
    for _ in range(rounds):
        votes = edges.join(accepted, "x").groupBy("c", "k").agg(F.sum("w").alias("w"), F.count("*").alias("accepted")).where(f"accepted >= {support}")
        now = votes.join(size, "c").select("c", "k", (F.col("w") / F.col("n")).alias("score")).where(F.col("score") >= least)
        now = materialise(now, "patterns")
        if good is not None and now.exceptAll(good).isEmpty() and good.exceptAll(now).isEmpty():
            break
        good = now
        told = edges.join(maybe_broadcast(good, 128), "c").groupBy("x", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("w")).where(F.col("w") >= least)
        accepted = materialise(seeds.unionAll(told.select("x", "k", "w")).groupBy("x", "k").agg(F.max("w").alias("w")), "accepted")
    return good


#: Patterns up to so many are looked up row by row; more are joined.
LOOKED_UP = 1 << 16
MORE = "array<struct<k:int,s:bigint,e:bigint>>"


def discovered(scanned: DataFrame, good: DataFrame) -> DataFrame:
    """scanned with more: spans that good patterns add, each of the kind with the best score (ties: first kind).

    Good patterns are few words; while they are, each row finds its contexts in a map and nothing is shuffled. Beyond, rows are joined."""
    best = good.groupBy("c").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("kind"))
    n = best.count()
    if not n:
        return scanned.withColumn("more", F.expr(f"cast(array() as {MORE})"))
    if n <= LOOKED_UP:
        buckets = math.isqrt(n) + 1
        maps = best.groupBy(F.pmod(F.xxhash64("c"), F.lit(buckets)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("c", "kind"))).alias("m"))
        known = maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("known"))
        kind = f"try_element_at(try_element_at(_known, pmod(xxhash64(x.c), {buckets}L)), x.c)"
        out = scanned.withColumn("_known", known.scalar())
        return out.withColumn("more", F.expr(f"transform(filter(cand, x -> {kind} is not null), x -> struct({kind} as k, x.s as s, x.e as e))")).drop("_known")
    scanned = materialise(scanned, "spans")  # a row's number must be the same on both sides
    rows = scanned.where("size(cand) > 0").select("rid", F.explode("cand").alias("i")).select("rid", "i.*")
    more = rows.join(maybe_broadcast(best, 128), "c").groupBy("rid").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("more"))
    return scanned.join(more, "rid", "left").withColumn("more", F.coalesce("more", F.expr(f"cast(array() as {MORE})")))


def personal_spans(documents: DataFrame, rounds: int = 6, least: float = 0.8, support: int = 5) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, base, spans), arrays of (k, s, e) in the order of kind, then start.

    k is the place in KINDS, s and e are code points, e exclusive. Base spans are the leftmost non-overlapping matches per kind
    that pass the kind's check; failing matches are dropped and not tried again. spans also has what the method adds, which never
    touches a base span. Null texts have no spans. Repeated rows are kept, extra columns are not read, an
    empty table gives no rows.
    """
    scanned = materialise(scan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "spans")
    found = discovered(scanned, patterns(scanned, rounds, least, support))
    found = found.select("doc_id", F.expr("transform(base, x -> struct(x.k as k, x.s as s, x.e as e))").alias("base"), "more")
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(documents: DataFrame, **how) -> DataFrame:
    """documents with every span in text replaced by its kind in brackets, all columns and rows kept; overlapping spans are
    replaced as one, named by the first. Texts are scanned twice, once for the patterns and once to replace, so no copy of them is stored."""
    good = patterns(scan(documents.select("text")), **how)
    found = discovered(scan(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), "text"), "_row"), good)
    out = found.select("_row", F.expr("array_sort(transform(concat(transform(base, x -> struct(x.k as k, x.s as s, x.e as e)), more), x -> struct(x.s as s, x.e as e, x.k as k)))").alias("m"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    start = "struct(0L as p, cast(array() as array<string>) as o)"
    step = f"if(x.s < a.p, struct(greatest(a.p, x.e) as p, a.o as o), struct(x.e as p, concat(a.o, array(substring(_row.text, cast(a.p + 1 as int), cast(x.s - a.p as int)), {names}[x.k])) as o))"
    text = f"if(size(m) = 0, _row.text, aggregate(m, {start}, (a, x) -> {step}, a -> array_join(concat(a.o, array(substring(_row.text, cast(a.p + 1 as int)))), '')))"
    out = out.withColumn("_text", F.expr(text))
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns])
