"""The queries opN_* and pipeline, and their SQL where SQL can say what they do."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, htmltext, langid, mixing, quality, simhash, substring, toxicity, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.query,
        "op2_toxicity": toxicity.query,
        "op3_quality_rules": quality.query,
        "op4_embedding_dedup": vectors.query,
        "op5_substring_dedup": substring.query,
        "op6_html_text": htmltext.query,
        "op7_bpe": bpe.query,
        "op8_mixing": mixing.query,
        "op9_simhash": simhash.query,
        "op10_language_id": langid.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op5_substring_dedup": substring.SQL, "op8_mixing": mixing.SQL}
