"""From documents to a training mix, in five stages: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, columns of any names, and empty
tables, and says below what becomes of them; ties are decided by id and then by a hash of the text, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenaudit.llm import decontam, linewindows, mixing, quality, simhash
from lumenaudit.llm.common import documents, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go.

    Rows are judged each on its own, so repeats go or stay together. Null, empty and wordless texts have no features: the
    scorer's bias judges them, and they stay wherever most documents are good.
    """
    return quality.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines in a row go; a document that loses all its words goes.

    Null texts and those of under three lines stay as they are. Rows that repeat id and text are one document.
    """
    return linewindows.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) the one with the smallest id stays.

    Null and wordless texts, and rows without id, all stay. Rows that repeat an id go or stay together.
    """
    return simhash.near_duplicates_out(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages go; a document that loses all its words goes.

    Texts without such a passage, null ones among them, stay as they are; repeats are treated alike.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and epoch of the mix, with `epoch` and `words` (after underscores where documents has such columns).

    Null and wordless texts are in no mix; a null source is a source; repeated rows are documents of their own.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The scorer's fit and the fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
