"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import jaccard, packing, quality, repeats, toxicity
from terrafold.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_rules", quality.stage),
    ("jaccard_join", jaccard.stage),
    ("substring_dedup", repeats.stage),
    ("best_fit_packing", packing.stage),
]

#: Learned scores and hashed candidates aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and reread as the next one's input.

    Null and empty texts go with the quality rules; repeated rows are judged alike until the Jaccard join keeps one of
    each doc_id; an empty table gives no rows; columns beyond those of documents pass through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
