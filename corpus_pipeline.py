"""The corpus pipeline: rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.

Every stage takes rows as they come: null or empty texts, texts of any length, repeated rows, ties and
columns of any name have the results given below, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.common import materialize, spread, table
from quarryline.llm.lines import apply_line_rules
from quarryline.llm.mixing import poisson_mix
from quarryline.llm.ngram_join import one_of_each
from quarryline.llm.packing import pack_documents
from quarryline.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the host's limit go from those that stay.

    A null or empty text has no words and goes; a null host is a host of its own; repeated rows share one verdict; of
    documents that share a line above the limit, the one with the smallest id (null first) keeps it."""
    return apply_line_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles alike to 80 percent stays, the one with the smallest id.

    Texts without words stay; of rows with equal id and text one stays; rows with a null id come after all others."""
    return one_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has go; a document of which nothing is left goes.

    A passage is 13 words or more, wherever they lie; rows of one id are one document, and words are judged on the
    stage's input, whatever else of it goes."""
    return remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in a global random order.

    A null source is a source of its own; rows of one id are drawn alike; a document may be drawn no time."""
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):  # the mix's own columns take no name that is in use
        prefix = "_" + prefix
    return poisson_mix(docs, prefix=prefix).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048.

    A null or empty text is its end id alone; a text of any length is cut freely; repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Tokenised pieces are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
