"""The registered queries of this subpackage and the SQL that those which SQL can express must equal."""

from __future__ import annotations

import public_tokenizers as tokenizers

from alloyscreen.llm import alignment, bpe, fuzzy_lines, importance, lexical, license_scan, line_rules, near_duplicates, oracles, packing, secret_scan, token_counts, token_files, vectors
from alloyscreen.session import run_folder


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op2_importance(spark, sf_dir):
    return importance.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_rules(spark, sf_dir):
    found = line_rules.line_first(_read(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


def op5_secret_scan(spark, sf_dir):
    return secret_scan.scanned(_read(spark, sf_dir, "documents")).drop("row", "found")


def op7_fuzzy_lines(spark, sf_dir):
    return fuzzy_lines.deduplicated(_read(spark, sf_dir, "documents")).select("doc.doc_id", "n_lines", "n_dropped", "n_left", "text")


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_near_vectors(spark, sf_dir):
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_token_files(spark, sf_dir):
    folder = run_folder(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), folder, tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op10_packing(spark, sf_dir):
    return packing.packed(_read(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op11_ranked_search(spark, sf_dir):
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_license_scan(spark, sf_dir):
    return license_scan.licenses(_read(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return alignment.aligned(_read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), tokenizers.PATTERN)


QUERIES = {
    q.__name__: q
    for q in (
        op1_byte_bpe, op2_importance, op3_line_rules, op4_token_counts, op5_secret_scan, op6_near_duplicates, op7_fuzzy_lines, op8_near_vectors,
        op9_token_files, op10_packing, op11_ranked_search, op12_license_scan, op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {"op3_line_rules": oracles.line_first(), "op5_secret_scan": oracles.scanned(), "op11_ranked_search": lexical.oracle(), "op12_license_scan": license_scan.oracle()}
