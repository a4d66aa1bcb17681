"""The package's queries: name -> function of (session, directory of tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import hamming, licenses, neardup, packing, pii, quality, secrets, sentencepieces, tokencount, toxicity
from .common import table, tune
from .sql import SQL  # noqa: F401


def op1_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.tokenizer_path(tokencount.MODEL))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokencount.tokenizer_path(packing.MODEL))


def op2_sentencepiece_nbest(spark, sf_dir):
    """Count and crc32 of each of the n best (n_pieces and ids_crc32 are those of the best), scores, whether all decode to the text."""
    tune(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", sentencepieces.nbest_digest_column(tokencount.tokenizer_path(sentencepieces.MODEL)).alias("d")).select("doc_id", "d.*")
    first = lambda c: F.col(c)[0]
    return rows.select("doc_id", first("n_pieces").alias("n_pieces"), first("ids_crc32").alias("ids_crc32"), first("scores").alias("best_score"), "scores", "restored", F.col("n_pieces").alias("n_best_pieces"), F.col("ids_crc32").alias("n_best_crc32"))


def op3_hamming_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=10)


def op7_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (op1_secret_scan, op2_sentencepiece_nbest, op3_hamming_topk, op4_license_scan, op5_toxicity, op6_quality_rules, op7_personal_data, op8_near_duplicates, op9_token_counts, op10_best_fit_packing)
QUERIES = {f.__name__: f for f in _ALL}
