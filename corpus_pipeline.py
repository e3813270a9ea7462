"""Five stages from the table of documents to packed training sequences.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame); what one returns is written
as Parquet and read again as the docs of the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import jaccard, language, packing, quality, repeats
from tallyframe.llm.queries import remainder
from tallyframe.llm.tables import may_be_in, split_by, written
from tallyframe.llm.text import set_up

# packing has no SQL form; the tests hold the stages against brute force
ORACLE_SQL = None
MIN_QUALITY = 0.5
MIN_LANGUAGE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; it learns from the labels of its training rows.
    Null and empty texts are scored as others are."""
    set_up(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    train = docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    model = quality.fit(quality.labelled_rows(train.select("doc_id", "text"), labels))
    return _own(docs, quality.predict(_renamed(docs), model).where(F.col("score") >= MIN_QUALITY))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: not undetermined (null and empty texts and
    those without letters are), more likely than not, and not less probable than texts of that
    language are. Three folds of documents teach the model, a fourth one its bounds."""
    set_up(spark)
    fold = F.coalesce(remainder("doc_id", 5), F.lit(2))
    labelled = docs.select("doc_id", "text", "lang")
    model = language.with_bounds(language.fit(labelled.where(fold >= 2)), labelled.where(fold == 1))
    found = language.predict(_renamed(docs), model)
    return _own(docs, found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE) & F.col("familiar")))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest number of each group of near copies, rows without a number
    after all others. A row is known by its number and the hash of its text, so of two texts under
    one number only the copy goes; of rows equal in number and text one stays. Texts without
    words (null ones too) are copies of nothing."""
    set_up(spark)
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    found = written(jaccard.join(docs.select(row.alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "near_copies")
    linked = found.where("row != component_id").distinct()
    # the rows of all groups of two or more, with their numbers
    grouped = linked.union(linked.select(F.col("component_id").alias("row"), "component_id").distinct())
    numbers = may_be_in(docs.select(row.alias("row"), "doc_id"), "row", grouped.select("row")).distinct()
    grouped = written(grouped.join(numbers, "row"), "near_groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    copies = grouped.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("row")
    again = found.groupBy("row").count().where("count > 1").select("row")
    # only rows that may be copies are shuffled to the joins that decide
    marked = docs.select(F.struct(*docs.columns).alias("own"), row.alias("row"))
    perhaps, kept = split_by(marked, "row", copies.union(again))
    perhaps = perhaps.join(copies, "row", "left_anti").dropDuplicates(["row"])
    return perhaps.select("own.*").union(kept.select("own.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; documents with nothing left go."""
    set_up(spark)
    cut = repeats.remove(docs, written(repeats.spans(docs), "spans"))
    return cut.where(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.
    Null and empty texts are the end id alone; an empty table gives no pieces."""
    set_up(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_copies", keep_first_of_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_windows),
]


def _renamed(docs: DataFrame) -> DataFrame:
    """The row as one column beside the text, so that no column clashes with a result's."""
    return docs.select("text", F.struct(*docs.columns).alias("row"))


def _own(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select("row.*").select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    set_up(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
