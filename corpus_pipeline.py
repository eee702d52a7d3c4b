"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as written and read again, and returns
the columns of the documents; the last returns token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.catalog.registry import table
from docpress.llm.common import by_row, order_id, row_mark, stored, without
from docpress.llm.decontamination import contaminated
from docpress.llm.language import fit, identify_languages
from docpress.llm.lines import drop_repeated_lines
from docpress.llm.packing import pack_documents
from docpress.llm.simhash import drop_near_copies

# Words to a shingle, and the bits by which the fingerprints of copies may differ.
NEAR_WORDS, NEAR_BITS = 4, 4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages.

    Every row is judged by itself (a hash of all its columns tells it), also rows with a
    NULL or a repeated id.
    """
    found = identify_languages(by_row(docs), fit(docs), declared_col="lang", host_col="source")
    return without(docs, found.where(~F.col("accepted")).select(F.col("doc_id").alias("key")),
                   row_mark(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; all documents stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = drop_repeated_lines(docs, carry=others)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(
        *(F.col(f"carried.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near copies the row with the smallest id, and no other row.

    Every row is judged by its text, also rows with a NULL or a repeated id.
    """
    return drop_near_copies(docs, width=NEAR_WORDS, radius=NEAR_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Every row is judged by itself (a hash of all its columns tells it), also rows with a
    NULL or a repeated id.
    """
    hits = contaminated(by_row(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, hits.select(order_id("doc_id").alias("key")), row_mark(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return pack_documents(docs)


STAGES = [
    ("language", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# SQL has no shingle components, no language model and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
