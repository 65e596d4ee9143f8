"""Queries of this package, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    decontamination, exact_dedup, fixity, lattice, manifest, multi_index, near_dedup, packing, pieces, quality, repair, repeats, url_filter,
)
from tablewright.llm.common import held_out, table
from tablewright.llm.oracles import contamination_sql, manifest_sql, repair_sql
from tablewright.session import written

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = lattice.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scores = lattice.lattice_scores(table(spark, folder, "documents"), vocabulary, ~held_out("doc_id", 1))
    return scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scores = quality.quality_scores(docs, labels, ~held_out("doc_id", 0))
    return scores.select("doc_id", (~F.col("trusted")).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM texts
"""


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, cached=1_000_000)
    placed = packing.pack(pieces)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bottom_k_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"), near_dedup.Likeness(words=4))


def op7_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as an archive, against a second copy of it with changed, cut and lost records."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    body = (
        F.when(F.col("page_id") % 97 == 0, F.concat(F.lit("~"), F.substring(body, 2, 2_147_483_647)))
        .when(F.col("page_id") % 103 == 7, F.expr("substring(coalesce(html, ''), 1, length(coalesce(html, '')) div 2)"))
        .otherwise(body)
    )
    copies = pages.withColumn("other", body)
    one, two = fixity.record("url", "html"), fixity.record("url", "other")
    records = copies.select(
        "page_id", F.octet_length(one).cast("long").alias("length"), F.sha2(one, 256).alias("hash"),
        F.octet_length(two).cast("long").alias("length_2"), F.when(F.col("page_id") % 101 != 5, F.sha2(two, 256)).alias("hash_2"),
    )
    archive = written(fixity.placed(records, "page_id"), "archive")
    first = archive.select("file", "offset", "length", "hash")
    second = archive.filter("hash_2 is not null").select("file", "offset", F.col("length_2").alias("length"), F.col("hash_2").alias("hash"))
    return archive.select("page_id", "file", "offset").join(fixity.audit(first, second), ["file", "offset"])


_WARC_SQL = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({0})
  || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"""
OP7_SQL = f"""
WITH bodies AS (
  SELECT page_id, url, coalesce(html, '') AS one,
         CASE WHEN page_id % 97 = 0 THEN '~' || substr(coalesce(html, ''), 2)
              WHEN page_id % 103 = 7 THEN substr(coalesce(html, ''), 1, length(coalesce(html, '')) // 2)
              ELSE coalesce(html, '') END AS two,
         row_number() OVER (ORDER BY page_id) - 1 AS n
  FROM pages),
records AS (SELECT page_id, n // 1000 AS file, n, {_WARC_SQL.format('one')} AS a, {_WARC_SQL.format('two')} AS b FROM bodies),
placed AS (
  SELECT *, CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records)
SELECT page_id, CAST(file AS BIGINT) AS file, "offset", CASE WHEN page_id % 101 = 5 THEN 'missing' ELSE 'changed' END AS status,
       sha256(a) AS first_hash, CASE WHEN page_id % 101 <> 5 THEN sha256(b) END AS second_hash
FROM placed WHERE page_id % 101 = 5 OR a <> b
"""


def op8_piece_coding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; the file is a byte-pair model, so its scores are ranks."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    codes = pieces.encoded(table(spark, folder, "documents"), model, ranks=True).withColumns(
        {"n_ids": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")})
    kept = ["n_ids", "ids_crc32", "score", "uncovered"]
    return pieces.decoded(codes, model, kept).select("doc_id", *kept, F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, folder, "pages"), URL_RULES)


def op10_prefix_free_parsing(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof, and what it says about texts of which a third is tampered with."""
    docs = table(spark, folder, "documents")
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", url_filter._UPPER, url_filter._LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = manifest.leaf([*cells, F.col("text")])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, manifest.leaf([*cells, small])).alias("other"))
    proven = manifest.proofs(rows, "lang", ["doc_id"])
    folded = manifest.folded(F.coalesce("other", "leaf"), F.col("path"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair.Repair(repair.damaged(conversations), conversations).digests()


QUERIES = {
    "op1_subword_lattice": op1_subword_lattice,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_bottom_k_sketches": op6_bottom_k_sketches,
    "op7_merkle_fixity": op7_merkle_fixity,
    "op8_piece_coding": op8_piece_coding,
    "op9_url_filter": op9_url_filter,
    "op10_prefix_free_parsing": op10_prefix_free_parsing,
    "op11_decontamination": op11_decontamination,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op3_exact_dedup": OP3_SQL,
    "op7_merkle_fixity": OP7_SQL,
    "op11_decontamination": contamination_sql(),
    "op12_merkle_manifest": manifest_sql(),
    "op13_conversation_repair": repair_sql(),
}
