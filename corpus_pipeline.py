"""A training corpus from documents: language ID, line dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet to the shared
folder and read again before the next one starts.

Defined results: texts that are null or have no letter go at the first stage, other rows of null id pass it like any; a null id takes no part
in line dedup and stays; of rows that repeat an id with an equal text the join keeps one. Columns of any name pass through all
stages but the last. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, common, language, line_dedup, mixing, ngram_join

STAGES = [
    ("language ID", language.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("source mixing", mixing.stage),
    ("byte-level BPE", bpe.stage),
]

#: Suffix automata, patience diff and BPE merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Once a stage's result is written, all tables written for it and before it in this run are deleted."""
    with common.tables() as mine:
        docs = common.table(spark, sf_dir, "documents")
        for _, stage in STAGES:
            docs = common.cut(stage(spark, docs, sf_dir))
            common.sweep(spark, mine, keep=1)
        return docs
