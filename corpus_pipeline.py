"""From raw documents to packed training sequences, in stages that are written and read again one after another.

toxic documents go, one document of each group of near duplicates stays, personal data is masked, and what is left is packed.
SQL cannot express the model, the signatures or the tokenizer, so tests compare the stages with direct computations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickloom.llm import near_dup, packing, pii, toxicity
from brickloom.llm.common import stored
from brickloom.llm.queries import vocabulary
from brickloom.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, does not call toxic; texts stay as they are.

    Every row is scored by its own text, whole however long; a null or empty text has the score of an empty one, nulls in other
    columns change nothing, and repeated rows stay or go together. Without labels of both kinds every score is the share of
    toxic ones. An empty table stays empty, and further columns are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.filter("predicted = 0").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """Add ``number``: the doc_id, but for the different texts of a repeated doc_id one above all doc_ids for each."""
    print_ = F.xxhash64("text")
    clashes = docs.filter("doc_id IS NOT NULL").select("doc_id", print_.alias("print")).distinct()
    many = clashes.groupBy("doc_id").count().filter("count > 1")
    top = F.coalesce(F.lit(docs.agg(F.max("doc_id")).first()[0]).cast("long"), F.lit(0))
    # written, so that the numbers stay the same whoever reads them
    fresh = stored(clashes.join(many, "doc_id", "left_semi").withColumn("fresh", top + 1 + F.monotonically_increasing_id()))
    return docs.withColumn("print", print_).join(fresh, ["doc_id", "print"], "left").withColumn("number", F.coalesce("fresh", "doc_id")).drop("fresh", "print")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one of the least doc_id; of its repeated rows, one.

    Windows of five words, similarity of 0.8 or more. Documents without words or without doc_id stay. Different texts under
    one doc_id are documents of their own; in a group, a document whose doc_id is its own goes before them.
    Nulls in other columns and texts of any length change nothing. An empty table stays empty, and further columns are left out.
    """
    marked = numbered(docs.select(*COLUMNS))
    verdict = near_dup.near_duplicates(marked.filter("number IS NOT NULL").select(F.col("number").alias("doc_id"), "text"))
    kept = verdict.filter("kept").select(F.col("doc_id").alias("number")).distinct()
    named = marked.join(kept.hint("merge"), "number", "left_semi")
    # rows of one number have equal texts; the least row stands for them
    single = named.groupBy("number").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of personal data replaced by its kind in brackets; n_chars follows. No document goes.

    Texts are searched whole. A null text stays null, an empty one empty; repeated rows give repeated rows, an empty table stays
    empty, and further columns are left out.
    """
    found = pii.find_spans(docs.select(*COLUMNS), out="_spans")
    return pii.mask(found, spans="_spans").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of at most 1024 tokens.

    A null or empty text is its end token alone; longer texts are cut into pieces, none is left out. Repeated rows are packed
    each, equal lengths take any order, a null doc_id stays null, and an empty table gives no piece.
    """
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
