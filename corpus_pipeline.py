"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Rows that a stage keeps are unchanged, whatever further columns they
have and however these are named. An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, langid, mixing, neardup, toxicity
from helixframe.llm.common import free_names, read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null and empty texts and texts without a letter go.

    Each row is judged by its text, a very long one by all of its windows; an id that is null or repeated makes no
    difference, and repeated rows all stay. Ties between languages don't matter here."""
    net = langid.fit(docs, held_out=langid.held_out())
    lang, score = free_names(docs, "lang_pred", "lang_score")
    return langid.predict(docs, net, out=(lang, score)).where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic: a score of 0.5 is toxic.

    Each row is judged by its whole text, null as the empty one; an id that is null or repeated makes no difference, and
    repeated rows all stay or all go. Without labels all stay."""
    model = toxicity.learnt(docs, read_table(spark, sf_dir, "labels"))
    score, called = free_names(docs, "toxic_score", "toxic_called")
    return toxicity.score(docs, model, out=(score, called)).where(F.col(called) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id.

    Rows of one id are one document, of which one row stays, the first by the hash of all its columns. Rows without an id
    are one document for each text, and stay where no document with an id is in their group. Null and empty texts are in no
    group."""
    (node,) = free_names(docs, "__node")
    judged = stored(neardup.near_duplicates(docs), "pipeline-judged")
    numbered = docs.withColumn(node, neardup.node_of(F.col("doc_id"), F.col("text")))
    gone = judged.where(F.col("node") != F.col("component")).select(F.col("node").alias(node)).distinct()
    left = numbered.join(gone, node, "left_anti")
    again = stored(judged.groupBy(F.col("node").alias(node)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(node), "pipeline-again")
    if again.limit(1).count():
        row = F.struct(*docs.columns)
        first = left.join(again, node, "left_semi").groupBy(node).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
        left = left.join(again, node, "left_anti").select(*docs.columns).unionByName(first.select("row.*"))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Texts are judged, not ids: rows with equal texts all stay or all go, whether their ids are null, repeated or neither.
    Null and empty texts stay."""
    (key,) = free_names(docs, "__text_key")
    keyed = docs.withColumn(key, F.md5(F.col("text").cast("binary")))
    leaks = decontam.matches(keyed, read_table(spark, sf_dir, "benchmark"), id_col=key).select(key).distinct()
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often, in the columns copies and taken (and size, source_size and target); where
    the table has a column of such a name already, ours is called mix_<name>.

    Each row is drawn for itself, whether its id is null, repeated or neither; of equal rows as many get a copy as they are
    due together. Null and empty texts have size 0 and may be drawn; null sources are a source."""
    mixed = mixing.mix_rows(docs)
    return mixed.where(F.col(mixed.columns[len(docs.columns) + 3]) > 0)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
