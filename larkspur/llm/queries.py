"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_join, html_text, minhash, packing, quality, substring, token_count, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_token_counts": token_count.op2_token_counts,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_embedding_join": embedding_join.op4_embedding_join,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_substring": substring.op6_substring,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_minhash": minhash.op8_minhash,
        "op9_warc": warc.op9_warc,
        "op10_html_text": html_text.op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_join": embedding_join.ORACLE,
        "op6_substring": substring.ORACLE,
        "op8_minhash": minhash.ORACLE,
        "op9_warc": warc.ORACLE,
    }
