"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the docs of the
next. All but the last return the columns of ``documents``, whatever else they are named like inside. A row is a document:
repeated rows and null ids stay, but for ``near_dedup``. Empty tables give empty tables.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wicketworks.llm.common import documents, dropped, ready, stored  # noqa: E402
from wicketworks.llm.language import UNDETERMINED, held_out, identify_language  # noqa: E402
from wicketworks.llm.lines import dedup_lines  # noqa: E402
from wicketworks.llm.mixing import mix_sources  # noqa: E402
from wicketworks.llm.neardup import keep_one, near_duplicates  # noqa: E402
from wicketworks.llm.packing import pack, public_tokenizer  # noqa: E402

LEAST_SCORE = 0.5


def _columns(docs: DataFrame, **other) -> list:
    return [other[c].alias(c) if c in other else F.col("row")[c].alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them, and those that no language explains better than the
    others together. Rows without a lang are judged like the others and not learned from."""
    ready(spark)
    labelled = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    found = identify_language(docs, labelled)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes shared lines out of the texts; n_chars follows. Documents left without text stay, as empty, and null texts
    become empty. Of equal ids one row keeps its lines as the other does."""
    ready(spark)
    kept = F.col("kept")
    return dedup_lines(docs).select(*_columns(docs, text=kept, n_chars=F.length(kept).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least id, and one of rows that repeat it with their id.
    Documents without words are in no group. Rows without an id stay where no row of their group has one."""
    ready(spark)
    return keep_one(docs, near_duplicates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that each source has its share of the words. Null sources are one source; texts
    without words are taken as often as their source's are for certain. Rows of equal ids are taken or left together."""
    ready(spark)
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of all that is left in sequences of 4096. A null text is the end mark alone."""
    ready(spark)
    return pack(docs, public_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned languages and token ids are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read from there; the one before then goes."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
