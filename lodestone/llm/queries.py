"""The registered queries of this package: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat_format import prefix_tree, read_back
from .common import materialise, shared_dir, table
from .decontaminate import NEAR, build_index, contamination, search
from .fill_in_middle import fill_in_middle, restored
from .hard_negatives import hard_negatives
from .html_text import extract
from .language_id import identify, train
from .near_dedup import near_duplicates
from .packing import pack
from .pii import KINDS, personal_spans
from .quality_rules import judge, rule_statistics
from .token_output import write_shards
from .toxicity import score_texts
from .toxicity import train as train_toxicity

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLES["op2_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.i >= 85 * (x.n + y.n - i.i)
), r(doc_id, node) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node
), c AS (SELECT doc_id, min(node) AS c FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0
), z AS (SELECT DISTINCT n FROM i
), p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS at0, w FROM d, z WHERE len(w) >= n
), o AS (SELECT p.doc_id, p.at0, p.n, i.item_id FROM p JOIN i ON i.n = p.n AND i.g = array_to_string(p.w[p.at0:p.at0 + p.n - 1], ' ')
), h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(at0, at0 + n)) AS k FROM o) GROUP BY 1
), m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM o GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: the benchmark items of which a window stands in a document with each word within NEAR words of its place."""
    found = search(materialise(build_index(table(spark, sf_dir, "documents")), "index"), table(spark, sf_dir, "benchmark"), near=NEAR)
    return found.select("doc_id", "n_words", F.size("items").cast("long").alias("n_items"), F.size("near_items").cast("long").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"))


@query
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans."""
    found = personal_spans(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), x["k"] + 1), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id are never learned from, and held_out is false for them."""
    documents = table(spark, sf_dir, "documents")
    held = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, false)").alias("held_out")
    return identify(documents, train(documents)).select("doc_id", held, "lang_pred", "score", "accepted")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id are never learned from, and held_out is false for them."""
    documents = table(spark, sf_dir, "documents")
    model = train_toxicity(documents, table(spark, sf_dir, "labels"), "pmod(crc32(cast(doc_id as string)), 3) <> 1")
    held = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)").alias("held_out")
    return score_texts(documents, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "windows")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(*prefix_tree(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS c1, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:c1], '') AS a, array_to_string(u[c1 + 1:c2], '') AS m, array_to_string(u[c2 + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "anomalous")


@query
def rule_statistics_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules of op12 rest on, as SQL has it too."""
    return rule_statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


ORACLES["rule_statistics_of_texts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d
), n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1
), g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2
), t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS times FROM g
), r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM t WHERE times > 1) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is moved on by one, modulo 10; components are floor(256 x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    # what no whole number stands for (null, nan, infinite) stays as it is, so the operator leaves the row out
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.floor(256 * x.cast("double")).cast("double")).otherwise(x.cast("double")))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label, whole.alias("v")))


ORACLES["op13_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
