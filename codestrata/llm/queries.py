"""One query per operator over the whole of its table, with SQL where SQL can express the result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (chat, decontamination, fingerprint, licenses, lines, manifest, mixing, negatives, oracles,
               quality_ratio, repeats, simhash, tokens, toxicity)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def held_out():
    return toxicity.remainder() == 0


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model fitted on labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


@query("op2_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without 400-byte strings that repeat."""
    return repeats.cut_repeats(table(spark, sf_dir, "documents"), keep_text=False)


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (  -- the length of a turn as written: escaped where the plain form would not come back
  SELECT *, length('### ' || url_encode(role) || ': ' || '</turn>' || chr(10)) + CASE
           WHEN contains(text, '###') OR contains(text, '</turn>') THEN
             1 + length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'))
           ELSE length(text) END AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op3_chat", CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    probes = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return chat.digest(chat.read_back(chat.format_chats(rows.unionByName(probes))))


@query("op4_lines")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and nearly repeated lines."""
    rows = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=None)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LEAK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
place AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item))),
found AS (SELECT place.k, place.i, item.n, item.item_id FROM place JOIN item ON place.n = item.n AND place.p = item.p),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM found) GROUP BY k),
ids AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN ids USING (k)"""


@query("op5_decontamination", LEAK_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows inside all documents."""
    return decontamination.digest(decontamination.scan(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS n,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left,
         2.0 * coalesce(sum(source_size) OVER b, 0)::DOUBLE AS full_before, row_number() OVER o AS turn
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST),
  b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (n * 1.5 - full_before) / w_left AS level FROM r),
first AS (SELECT level FROM l WHERE level * w <= 2.0 * source_size ORDER BY turn LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM first) * w, 2.0 * source_size),
                                        2.0 * source_size) AS target FROM l),
k AS (
  SELECT source, source_size, target, k,
         greatest(0.0, least(target - source_size * (k - 1.0), source_size::DOUBLE)) AS budget
  FROM t, (SELECT unnest([1, 2]) AS k)),
leaf AS (  -- the upper 36 of 60 bits: where the last round of the refinement stands
  SELECT source, h >> 24 AS b, sum(size) AS z FROM d GROUP BY ALL),
run AS (SELECT *, sum(z) OVER (PARTITION BY source ORDER BY b) AS upto FROM leaf),
cut AS (  -- a leaf is in if at least half of it fits
  SELECT k.source, k.k, min(r.b) FILTER (WHERE r.upto - r.z / 2.0 > k.budget) AS b
  FROM k JOIN run r ON r.source IS NOT DISTINCT FROM k.source GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (
         CASE WHEN c1.b IS NULL OR d.h >> 24 < c1.b THEN 1 ELSE 0 END +
         CASE WHEN c2.b IS NULL OR d.h >> 24 < c2.b THEN 1 ELSE 0 END) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
JOIN cut c1 ON c1.k = 1 AND c1.source IS NOT DISTINCT FROM d.source
JOIN cut c2 ON c2.k = 2 AND c2.source IS NOT DISTINCT FROM d.source"""


@query("op9_mixing", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the byte-level vocabulary."""
    import public_tokenizers

    rows = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op13_manifest", oracles.MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, with the proof of a tampered text in every third place."""
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.lower_ascii(text)).otherwise(text)
    return manifest.verified(manifest.proofs(table(spark, sf_dir, "documents"), {"text": changed}))


@query("op11_quality_ratio", oracles.RATIO_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the log-likelihood ratio of all documents, trusted by the quality labels."""
    return quality_ratio.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_hard_negatives", oracles.NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
