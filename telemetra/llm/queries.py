"""The queries of this package: ``(spark, sf_dir) -> DataFrame`` with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, html_text, langid, license, lm_score, merkle, oracle, packing, pieces, quality, simhash, toxicity, trie, warc
from ..session import scratch_path
from .tables import held_out, learnable, stored, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf, "documents").select("doc_id", "text"), held_out("doc_id", 7, 2))


def op2_warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), path, min_bytes=0)
    full = warc.transactions(spark, path)
    r = F.col("response")
    fields = F.decode(F.col("metadata")[0]["payload"], "utf-8")
    # what a revisit leaves out is that of the capture it refers to; the payloads stay behind
    slim = stored(full.select("capture_id", F.regexp_extract(fields, r"page_id: (\S+)", 1).try_cast("long").alias("page_id"), r["record_type"].alias("record_type"),
                              r["refers_to"].alias("refers"), F.octet_length(r["payload"]).cast("long").alias("size"),
                              F.when(r["record_type"] == "response", warc.base32_sha1(r["payload"])).otherwise(r["payload_digest"]).alias("payload_digest")), "captures")
    origin = slim.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("size").alias("full_size"))
    return slim.join(origin, "refers", "left").select(
        "page_id", F.when(F.col("record_type") == "response", F.col("size")).otherwise(F.col("full_size")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = exact_dedup.exact_duplicates(table(spark, sf, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode_texts(table(spark, sf, "documents"), path, ["doc_id", "text"])
    back = pieces.decode_pieces(coded, path, ["doc_id", "text", "pieces"])
    # a text that itself holds the blank sign comes back with blanks, as from any decoder of the model
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))


def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_langid_ecoc(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.where(learnable("doc_id", 5, 0)))
    got = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = toxicity.train(docs, table(spark, sf, "labels"), learnable("doc_id", 4, 2))
    got = toxicity.score_toxicity(docs, index, ["doc_id"])
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                      "evidence", "similarity")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    measured = quality.measure(table(spark, sf, "documents"), ["doc_id"])
    got = quality.judge(measured, quality.fit(measured))
    return got.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "quality")


def pack_documents(docs: DataFrame) -> DataFrame:
    cut = stored(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")), "pieces")
    slim = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")      # the ids stay where they are stored
    return packing.place(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_token_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return license.scan(docs, license.train(docs))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.proofs(merkle.build(merkle.leaves(table(spark, sf, "documents"), tampered=changed)))


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf, "conversations"))


def op13_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"), ["page_id", "url"]).select("page_id", "url", "text", "n_chars", "covered")


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_langid_ecoc": op6_langid_ecoc,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_packing": op9_token_packing,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_html_text": op13_html_text,
}

ORACLE: dict[str, str] = {
    "op11_merkle_manifest": oracle.MERKLE,
    "op12_conversation_trie": oracle.TRIE,
    "op2_warc_transactions": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
  FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 10 * (x // 8) + 1, 10) AS BIGINT)
         >> CAST(35 - 5 * (x % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1) for x in range(32)], '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}
