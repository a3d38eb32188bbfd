"""A corpus from raw documents: good texts, one of each near-duplicate group, no benchmark passages, no secrets, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept, read again from Parquet.
Texts of any length are taken whole; null ids and texts pass every stage that has no reason to drop them;
columns beside the documents' own, whatever they are called, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline.llm import bpe, decontam, jaccard_join, quality, secret_scan
from leadline.llm.common import scratch, table, written
from leadline.llm.queries import BYTE_BPE, RANKS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labelled ones outside fold 0.

    A null or empty text has the score of no features, repeated rows have one fate, null ids don't matter, an
    empty table gives an empty one.
    """
    return quality.good_texts(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    Rows of one id are one document: its different texts all stay or all go, and of rows with one id and one
    text one stays, which one is not said. Null and empty texts are like nothing and stay, and so do all rows
    with a null id; an empty table gives an empty one.
    """
    groups = jaccard_join.similar_groups(docs, words=5, percent=80)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    # under names of our own, since a column may be called anything
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows, key, text = docs.toDF(*own.values()), own["doc_id"], own["text"]
    here = rows.join(first.withColumnRenamed("doc_id", key), key, "left_semi")
    order = Window.partitionBy(key).orderBy(text)
    one = here.withColumn("again", (F.row_number().over(order) > 1) & F.lag(text).over(order).eqNullSafe(F.col(text))).filter("not again").drop("again")
    return one.unionByName(rows.filter(F.col(key).isNull())).select(*[F.col(v).alias(c) for c, v in own.items()])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs; null and empty texts, null ids and repeated rows are kept, an empty table gives an empty one."""
    return decontam.clean_texts(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and n_chars kept true; null texts stay null, an empty table gives an empty one."""
    return secret_scan.without_secrets(docs, RANKS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to.

    Null and empty texts have no ids, null ids stay null, repeated rows give repeated results, an empty table an
    empty one; other columns are not read.
    """
    return bpe.encode_decode(docs, BYTE_BPE, with_text=False).drop("decoded")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: The stages score, tokenise and align, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage read or made for itself goes when its result is written."""
    with scratch() as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            with scratch() as hold:
                docs = hold(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        return keep(docs)
