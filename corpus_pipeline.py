"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.llm import common, decontaminate, mixing, simhash, token_files, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: likeness of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _same(docs: DataFrame, marks: DataFrame):
    return (F.col("__key") == marks["m_key"]) & F.col("doc_id").eqNullSafe(marks["m_doc_id"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model is fitted on these docs' labels.

    Null and empty texts have no hits and stay; repeated rows are judged alike; without
    labels of both classes nothing goes; an empty table gives none.
    """
    common.tidy(spark)
    scored = toxicity.score_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id; of repeated rows, one.

    Groups hang on pairs whose five-word shingles have a similarity of 0.8 or more. Null, empty and
    wordless texts are one group; shorter texts than a shingle are one shingle; a group of null ids
    only keeps one row; an empty table gives none.
    """
    common.tidy(spark)
    groups = simhash.similar_documents(docs, shingle=SHINGLE, similarity=SIMILARITY)
    named = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    marks = named.groupBy("root").agg(F.first("component_id").alias("m_doc_id"), F.min("key").alias("m_key")).drop("root")
    kept = _with_key(docs).join(marks, _same(docs, marks), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and empty texts have no words and stay; repeated rows are judged alike; items without id or
    words have no windows; an empty table gives none.
    """
    common.tidy(spark)
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).where("contaminated")
    marks = found.select(F.col("doc_id").alias("m_doc_id"), F.col("key").alias("m_key"))
    return _with_key(docs).join(marks, _same(docs, marks), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's mixture takes it: not at all, once or twice.

    Null and empty texts have no words and are taken once; a null source is a source of its
    own; repeated rows are separate documents, whose copies add up; an empty table gives none.
    """
    common.tidy(spark)
    mixed = mixing.mix(docs)
    # repeated rows are separate documents there; their copies add up here
    marks = mixed.groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("m_rows")).where("copies > 0")
    marks = marks.select(F.col("doc_id").alias("m_doc_id"), F.col("key").alias("m_key"), "copies", "m_rows")
    one = _with_key(docs).dropDuplicates(["doc_id", "__key"])
    joined = one.join(marks, _same(one, marks))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; per row what they hold: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; null ids come first; repeated rows are written
    as often as they are there; an empty table gives no file and no row.
    """
    common.tidy(spark)
    return token_files.token_digest(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}")
    return docs


#: A trained model, components and fitted rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
