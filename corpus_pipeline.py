"""From raw documents to token ids: five stages, each an operator of ``fieldloom.llm``.

Each stage gets what its predecessor kept and returns the columns of documents, the
last one tokens.  ``run`` writes each stage's rows to the shared folder and reads them
back.  No stage has SQL of its own (a trained model, sets and surrogates), so the
pipeline is tested against versions on small tables.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, language, mixing, ngram_join, pii
from fieldloom.llm.common import materialize, table, unused
from fieldloom.operators.bounds import fits

#: A document is kept if its language has this share of its letters.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle and similarity.
WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Bytes of the batches that go to Python workers, where the session says nothing: ten thousand whole texts would be one otherwise.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches bounded by bytes, not by rows alone, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those without one main language; the model is learned from these documents.

    If none of them is labelled there is nothing to tell languages by, and all stay.
    """
    bound_batches(spark)
    model = language.learn(docs)
    if model.languages == [language.UNKNOWN]:
        return docs
    found, score = unused(docs.columns, "_lang_pred"), unused(docs.columns, "_score")
    labelled = language.predict(docs, model, "text", found, score)
    return labelled.filter((F.col(found) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, made once and written, and its name; ids may be null or repeat."""
    key = unused(docs.columns, "_row")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id())), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the smallest id, a null one last.

    Rows are grouped by their texts, whatever their ids: copies under one id or without one stay once,
    different texts under one id stay apart.  Without words nothing is a near copy, only a repeated id is.
    """
    bound_batches(spark)
    rows, key = with_row_key(docs)
    groups = ngram_join.ngram_components(rows.select(key, "text"), WIDTH, SIMILARITY, id_col=key).withColumnRenamed("doc_id", "_key")
    named = groups.join(rows.select(F.col(key).alias("_row"), "doc_id"), F.col("_key") == F.col("_row"))
    repeated = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    named = materialize(named.select("_row", "doc_id", F.when(~repeated, F.col("component_id")).alias("_group"), F.when(repeated, F.col("doc_id")).alias("_same")))
    first = named.groupBy("_group", "_same").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    gone = materialize(named.select("_row").join(first.select(F.col("first._row").alias("_row")), "_row", "left_anti").withColumnRenamed("_row", key))
    gone = F.broadcast(gone) if fits(gone) else gone
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates and counts characters anew."""
    clean = pii.replace_pii(docs, count_col=None)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it, a last partial use included; one that is not taken goes."""
    rows, key = with_row_key(docs)
    times = unused(docs.columns, "_times")
    mixed = mixing.mix(rows.select("doc_id", "text", "source", key), kept=(key,))
    taken = materialize(mixed.filter("taken > 0").select(key, F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times)))
    taken = F.broadcast(taken) if fits(taken) else taken
    repeated = F.explode(F.sequence(F.lit(1), F.col(times)))
    return rows.join(taken, key).select(*docs.columns, repeated.alias(times)).drop(times)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and the digests of ids and decoded text."""
    bound_batches(spark)
    done = bpe.encode(docs, bpe.default_vocabulary(), decoded=True)
    return done.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii_surrogates", pii_surrogates),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
