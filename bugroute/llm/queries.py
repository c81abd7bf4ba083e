"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from bugroute.llm import (context_mixing, decontaminate, exact_dedup, filter_audit, langid, licenses, line_dedup, near_dedup,
                          pieces, token_blocks, toxicity, vector_codes, warc)
from bugroute.llm.common import fold, read_table


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op1_context_mixing(spark, sf_dir):
    return context_mixing.score_texts(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents")).drop("class_id", "text_key")


def op3_language_spans(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op4_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("rid", "text_key")


def op9_token_blocks(spark, sf_dir):
    return token_blocks.token_blocks(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    labels = read_table(spark, sf_dir, "labels").where(~held_out)
    model, coefficients = toxicity.train(docs, labels)
    return toxicity.score(docs, model, coefficients, [F.col("doc_id"), held_out.alias("held_out")])


def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id", F.col("kept").alias("text"), "n_lines", "n_dropped")


def op6_merge_dropout(spark, sf_dir):
    return pieces.encode_and_check(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_licenses(spark, sf_dir):
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("blocks")


def op11_warc(spark, sf_dir):
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings"))


CATALOG = {
    "op1_context_mixing": (op1_context_mixing, None),
    "op2_near_dedup": (op2_near_dedup, near_dedup.ORACLE_SQL),
    "op3_language_spans": (op3_language_spans, None),
    "op4_decontaminate": (op4_decontaminate, decontaminate.ORACLE_SQL),
    "op5_line_dedup": (op5_line_dedup, None),
    "op6_merge_dropout": (op6_merge_dropout, None),
    "op7_licenses": (op7_licenses, None),
    "op8_exact_dedup": (op8_exact_dedup, exact_dedup.ORACLE_SQL),
    "op9_token_blocks": (op9_token_blocks, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_warc": (op11_warc, warc.ORACLE_SQL),
    "op12_filter_audit": (op12_filter_audit, filter_audit.ORACLE_SQL),
    "op13_vector_codes": (op13_vector_codes, vector_codes.ORACLE_SQL),
}
