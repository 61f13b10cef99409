"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, sources are mixed
to their target weights, and what is taken is packed into windows.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: null texts count as empty: never toxic, one group of duplicates, of no size for the mix, an end token when
packed; rows without doc_id are documents like others; of repeated rows near_dedup keeps one; ties fall to the
smaller doc_id, then to a hash of the row; extra columns come through all stages but the last unchanged, whatever their names and
types; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm.common import stored, table
from hushframe.llm.mixing import mixed_documents
from hushframe.llm.packing import packed
from hushframe.llm.simhash import one_of_each
from hushframe.llm.toxicity import without_toxic

STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each),
    ("mixing", mixed_documents),
    ("packing", packed),
]

#: A learned lexicon, Hamming links and a public tokenizer aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(spark, docs, name)
    return docs
