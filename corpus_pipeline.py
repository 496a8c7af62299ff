"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them back for
the next. SQL cannot express the trained stage, so ``ORACLE_SQL`` is None and the
tests hold the pipeline against plain Python.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from curatrix.llm.common import col, materialize, read
from curatrix.llm.queries import packed_digest, tokenizer_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below one half, by a model of the rows labelled here."""
    return toxicity.clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without later occurrences of three-line windows.

    ``n_chars`` follows the text. A text that had characters and keeps none
    stays as an empty one.
    """
    out, _, _ = line_dedup.deduplicate(docs)
    out = out.select(*[col(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the least id."""
    return near_dedup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences, as op6_packing returns them."""
    return packed_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
