"""A corpus from raw documents: language, near duplicates, benchmark passages, mixture, token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import decontamination, language_id, mixing, ngram_join, token_store
from sparkfolio.llm.queries import table, tokenizer_path
from sparkfolio.llm.rows import free_name, keyed
from sparkfolio.llm.storage import freed, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject.

    Every row is decided by its text alone, so repeated rows and rows without a doc_id are decided alike or by themselves; null,
    empty and letterless texts are rejected.  Without any labelled row nothing can be identified and all rows go.  An empty
    table stays empty; further columns may have any name.
    """
    models = language_id.fit(docs.filter(~language_id.held_out()))
    own = [f"c{i}" for i in range(len(docs.columns))]
    own[docs.columns.index("text")] = "text"
    return language_id.identify(docs.toDF(*own), models, tuple(own)).filter("not rejected").select(own).toDF(*docs.columns)


def by_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """What an operator reads, with the rows' own key as doc_id."""
    return rows.select(F.col(key).alias("doc_id"), *columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each group of near duplicates, without one only if all are; of equal ids, by the text's hash.

    A repeated row is a copy and goes; null, empty and wordless texts are near nothing and stay; ties are decided by the
    row's key.  An empty table stays empty; further columns may have any name.
    """
    key = free_name(docs, "_row")
    rows = keyed(docs, key, "near_duplicates_rows")
    classes = ngram_join.near_duplicates(by_key(rows, key, "text")).select(F.col("doc_id").alias("_key"), F.col("class_id").alias("_class"))
    own = rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text"), F.col("_key").alias("key")))
    first = own.join(classes, "_key").groupBy("_class").agg(least.alias("least")).select(F.col("least.key").alias(key))
    return rows.join(first, key, "left_semi").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any occurrence of a benchmark window.

    Each row is decided by itself, whatever its doc_id; null and empty texts stay, as do all rows if there is no benchmark
    item.  An empty table stays empty; further columns may have any name.
    """
    key = free_name(docs, "_row")
    rows = keyed(docs, key, "decontamination_rows")
    found = decontamination.hit_rows(by_key(rows, key, "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.withColumnRenamed("doc_id", key), key, "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it: equal rows and rows without a doc_id each by themselves.

    Null and empty texts have no words, so they go as often as their source is taken in whole.  A null source is a source of
    its own.  An empty table stays empty; further columns may have any name.
    """
    key, many = free_name(docs, "_row"), free_name(docs, "_times")
    rows = keyed(docs, key, "mixing_rows")
    times = mixing.mix(rows.select("doc_id", "text", "source", key), keep=(key,)).filter("times > 0").select(key, F.col("times").alias(many))
    each = rows.join(times, key).select(F.struct(*docs.columns).alias("_r"), F.explode(F.array_repeat(F.lit(1), F.col(many).cast("int"))))
    return each.select("_r.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token store holds of each document: doc_id, start, n_tokens, ids_crc32.

    One row for each row, by ascending doc_id (null first); a null or empty text holds the end id alone.
    """
    return token_store.read_store(spark, token_store.write_store(docs, tokenizer_path()), tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixture), ("token_store", tokens)]

#: Language models and token ids are beyond SQL; tests hold each operator against brute force, and stages on small cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's result is written; what the stage wrote besides is removed then."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with freed(spark, lambda: kept):
            made = stage(spark, docs, sf_dir)
            kept.append(new_path(spark, name))
            made.write.parquet(kept[-1])
            docs = spark.read.schema(made.schema).parquet(kept[-1])
    return docs
