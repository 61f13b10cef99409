"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query, and the module whose function of that name runs it.
MODULES = {
    "op1_warc": "warc",
    "op2_toxicity": "toxicity",
    "op3_packing": "packing",
    "op4_simhash": "simhash",
    "op5_ann": "ann",
    "op6_fingerprints": "fingerprints",
    "op7_lm_scoring": "lm_scoring",
    "op8_token_files": "token_files",
    "op9_url_filters": "url_filters",
    "op10_mixing": "mixing",
    "op11_ball_kmeans": "ball_kmeans",
    "op12_alignment": "alignment",
    "op13_quality_ledger": "quality_ledger",
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"hushframe.llm.{MODULES[name]}"), name)(spark, sf_dir)

    return query


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in MODULES} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL has no tokenizer, no XXH64 and no learning; where it has all that a query needs, its counterpart is here."""
    from hushframe.llm import ball_kmeans, quality_ledger
    from hushframe.llm.warc import MIN_REVISIT

    return {
        "op1_warc": f"""
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to
            FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last
                  FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages))""",
        "op11_ball_kmeans": ball_kmeans.oracle_sql(),
        "op13_quality_ledger": quality_ledger.oracle_sql(),
    }
