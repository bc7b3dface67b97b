"""The corpus pipeline: five stages over ``documents``, each written and reread.

Rejected documents, all but one of each group of near copies, and documents with
benchmark passages go; personal data in the rest becomes pseudonyms; what stays
is packed into training sequences.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import stored, table
from sparkloom.llm.decontamination import decontamination_stage
from sparkloom.llm.line_quality import quality_stage
from sparkloom.llm.near_dedup import near_dedup_stage
from sparkloom.llm.pseudonyms import pseudonym_stage
from sparkloom.llm.sequence_packing import packing_stage

#: Percent of common shingles from which two texts count as near copies here; the
#: op5 query takes 85.
NEAR_PERCENT = 80

#: (name, function of (spark, docs, sf_dir)); all but the last return documents.
STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicate removal", partial(near_dedup_stage, percent=NEAR_PERCENT)),
    ("benchmark decontamination", decontamination_stage),
    ("pseudonyms", pseudonym_stage),
    ("sequence packing", packing_stage),
]

#: No SQL: the stages hold trained models and a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces (doc_id, piece, start, length, ids_crc32, offset,
    sequence_id) of what the first four stages leave of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
