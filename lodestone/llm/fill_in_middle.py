"""Fill-in-the-middle over relational units, in DataFrame and SQL functions only.

A text's units are the matches of one pattern that covers it without gaps. Two cut requests name units by ordinal; what they need
is the place where that unit ends:

1. matches are exploded with their positions, RUN consecutive ones to a row, as one row holds their summed length and, where a request
   falls into it, the single lengths; so a row is shuffled for RUN units, not for one, and no text is;
2. a window sums the lengths of a document's rows in their order;
3. cut requests join the rows by the ordinal of their unit;
4. the offsets are aggregated per document, join its text and cut it by substring.

Texts that stay as they are take no part in any of this: they never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, maybe_broadcast

#: Possessive forms of `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`: the same matches, each found without trying back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units in a row of the unit relation.
RUN = 256


def draws(doc_id: Column, salt: str = "42:", n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits, as numbers, of the digest of salt and doc_id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def forms(documents: DataFrame, moved: int = 50, suffix_first: int = 80) -> DataFrame:
    """documents with text (null: empty), h1, h2 and form: of 100 texts `moved` are cut, of 100 cut ones `suffix_first` become spm, the others psm.
    Empty texts and texts that hold a marker stay plain."""
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    t = documents.withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.pmod(h3, F.lit(100)) >= moved)
    return t.withColumns({"h1": h1, "h2": h2, "form": F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < suffix_first, "spm").otherwise("psm")})


def units(cut: DataFrame) -> DataFrame:
    """Rows of forms() that are to be cut -> one row for each doc_id and text (by its 64-bit hash t): n, c1 and c2 (the units before the middle and
    before the suffix), and runs, each with the sum of its units' lengths and, where c1 or c2 ends in it, those lengths."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), 0), lambda u: F.length(u))
    rows = cut.select("doc_id", F.xxhash64("text").alias("t"), "h1", "h2", lengths.alias("u")).withColumn("n", F.size("u").cast("long"))
    a, b = F.expr("pmod(h1, n + 1)"), F.expr("pmod(h2, n + 1)")
    rows = rows.withColumns({"c1": F.least(a, b), "c2": F.greatest(a, b)})
    run = f"""transform(sequence(0, cast((n - 1) div {RUN} as int)), r -> named_struct(
        'total', aggregate(slice(u, r * {RUN} + 1, {RUN}), 0L, (s, x) -> s + x),
        'u', if(r = (c1 - 1) div {RUN} or r = (c2 - 1) div {RUN}, slice(u, r * {RUN} + 1, {RUN}), null)))"""
    rows = rows.select("doc_id", "t", "n", "c1", "c2", F.expr(run).alias("runs"))
    return rows.dropDuplicates(["doc_id", "t"])  # within each task first, so a text that repeats is not gathered


def offsets(unit_rows: DataFrame) -> DataFrame:
    """Stored units() -> doc_id, t, n, p and m: where the prefix and the middle end, in code points."""
    runs = unit_rows.select("doc_id", "t", F.posexplode("runs").alias("run", "r")).select("doc_id", "t", "run", "r.total", "r.u")
    before = Window.partitionBy("doc_id", "t").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).where("u is not null").drop("total")
    asked = unit_rows.select("doc_id", "t", F.posexplode(F.array("c1", "c2")).alias("which", "c")).where("c > 0")
    asked = asked.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "which", F.expr(f"cast((c - 1) div {RUN} as int)").alias("at"), F.expr(f"cast((c - 1) % {RUN} + 1 as int)").alias("take"))
    found = asked.join(runs, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dt") == F.col("t")) & (F.col("at") == F.col("run")))
    end = F.expr("before + aggregate(slice(u, 1, take), 0L, (s, x) -> s + x)")
    ends = found.groupBy("d", "dt").agg(F.max(F.when(F.col("which") == 0, end)).alias("p"), F.max(F.when(F.col("which") == 1, end)).alias("m"))
    out = unit_rows.select("doc_id", "t", "n").join(ends, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dt") == F.col("t")), "left")
    return out.select("doc_id", "t", "n", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("m", F.lit(0)).alias("m"))


def _piece(start: Column, end: Column | None = None) -> Column:
    """Code points from start (from 0) to end (exclusive; None: to the end) of text."""
    return F.col("text").substr((start + 1).cast("int"), ((end - start) if end is not None else F.length("text")).cast("int"))


def fill_in_middle(documents: DataFrame, moved: int = 50, suffix_first: int = 80, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    Plain texts are their own output; psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle. Null texts are empty ones, with
    no units. A null doc_id draws as an empty string does. Rows that repeat a doc_id are formed each by its own text; repeated rows are all
    kept. Extra columns are not read, whatever their names; an empty table gives no rows.
    Offsets (40 bytes a document that is cut) are broadcast if their counted rows fit broadcast_bytes; beyond, texts that are cut are shuffled to them.
    """
    rows = forms(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), moved, suffix_first)
    same = rows.where("form = 'plain'").select("doc_id", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), "form", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("m"), F.col("text").alias("output"))
    cut = rows.where("form <> 'plain'")
    ends = materialise(offsets(materialise(units(cut), "units")), "offsets").withColumnsRenamed({"doc_id": "d", "t": "dt"})
    cut = cut.select("doc_id", "text", "form", F.xxhash64("text").alias("t")).join(maybe_broadcast(ends, 40, broadcast_bytes), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")))
    prefix, middle, suffix = _piece(F.lit(0), F.col("p")), _piece(F.col("p"), F.col("m")), _piece(F.col("m"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved_rows = cut.select("doc_id", "n", "form", "p", "m", F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return same.unionByName(moved_rows).select("doc_id", "n", "form", F.col("p").alias("prefix_chars"), (F.col("m") - F.col("p")).alias("middle_chars"), "output")


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that fill_in_middle() was given, from its form and output alone. No marker stands in a text that was cut, and no two markers can overlap."""
    first = f"if({form} = 'psm', '{SUFFIX}', '{PREFIX}')"
    one = f"substring({output}, 4, instr({output}, {first}) - 4)"
    two = f"substring({output}, instr({output}, {first}) + 3, instr({output}, '{MIDDLE}') - instr({output}, {first}) - 3)"
    middle = f"substring({output}, instr({output}, '{MIDDLE}') + 3)"
    return F.expr(f"case {form} when 'plain' then {output} when 'psm' then concat({one}, {middle}, {two}) else concat({two}, {middle}, {one}) end")
