"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hamming import TOP_K_SQL, sign_code, top_k
from tidemark.llm.html import extract_text
from tidemark.llm.language import predict_languages, train
from tidemark.llm.lexical import SEARCH_SQL, ranked_search
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import MIX_SQL, mix
from tidemark.llm.ngrams import score_texts
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.quality import judge
from tidemark.llm.repeats import repeated_spans
from tidemark.llm.tables import table
from tidemark.llm.tokens import encode_decode
from tidemark.llm.whitening import whiten


def crc(key: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


LM_ORDER = 3


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc("doc_id", 7) == 2)
    return score_texts(docs.withColumn("learning", ~F.col("held_out")), "learning", keep=("doc_id", "held_out"), order=LM_ORDER)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.where(F.col("vec_id") % 100 == 0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc("doc_id", 4) == 2)
    return predict_languages(docs, train(docs.where(~F.col("held_out"))), keep=("doc_id", "held_out"))


def digests() -> list[Column]:
    """Number and digest of token ids, and digest of the decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", *digests())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"))
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "_bytes"))
    # Spans follow one another from the first byte of the text to the last.
    gaps = F.filter(F.zip_with("begins", F.concat(F.array(F.lit(0)), "ends"), lambda a, b: a != b), lambda gap: gap)
    covered = (F.col("_bytes") == 0) | ((F.element_at("ends", -1) == F.col("_bytes")) & (F.size(gaps) == 0))
    return coded.select("doc_id", *digests(), covered.alias("spans_cover_text"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_hamming_top_k": op5_hamming_top_k,
    "op6_mixing": op6_mixing,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_language_id": op8_language_id,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_piece_round_trip": op12_piece_round_trip,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {"op5_hamming_top_k": TOP_K_SQL, "op6_mixing": MIX_SQL, "op13_lexical_search": SEARCH_SQL}
