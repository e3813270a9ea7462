"""One registered query for each operator: the operator with production parameters over
its whole table, and the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, fingerprints, jaccard, katz, language, licences, manifest, packing, quality, repeats, tokens, vectors
from .query_sql import CHAT, CODES, MANIFEST
from .tables import written
from .text import set_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    set_up(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of a number's text, modulo n: decides which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    model = language.fit(docs.where(~F.col("held_out")))
    return (language.predict(docs.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(quality.labelled_rows(docs.where(~F.col("held_out")), marks))
    return (quality.predict(docs.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "score", "predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = tokens.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
            .select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.passages(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document is a file of its source, in folders of a thousand
    files = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")).alias("path"))
    return licences.scan(files).select("doc_id", "path", "notice_license", "notice_score", "file_license", "inherited_license", "license")


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    coded = written(coded.select("vec_id", "label", "code", "error"), "codes")
    return codes.with_group_error(coded, "label").select(
        "vec_id", "code", "error", F.col("group_error").alias("label_error"), F.sha2(F.lit(codes.numbers(books)).cast("binary"), 256).alias("codebooks_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit(r"\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    found = chat.format_conversations(rows.unionByName(planted))
    found = found.select("conv_id", F.char_length("formatted").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("turns"),
                         chat.read_loss(F.col("segments")).alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    tampered = F.when((remainder("doc_id", 3) == 0) & F.col("text").isNotNull(), manifest.leaf(manifest.lowered())).otherwise(manifest.leaf())
    found = manifest.manifest(docs, tampered)
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")).alias("proof_sha256"),
                         manifest.folded(F.col("other"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_quality": op4_quality,
    "op5_licence_scan": op5_licence_scan,
    "op6_katz_lm": op6_katz_lm,
    "op7_packing": op7_packing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_format": op12_chat_format,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op8_embedding_near_dedup": """
WITH RECURSIVE usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k
    FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op11_vector_codes": CODES,
    "op12_chat_format": CHAT,
    "op13_merkle_manifest": MANIFEST,
}
