"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a share of all words by its weight, at most ``cap`` times its own
words; what is cut off is shared again by weight.  A target is filled by complete
epochs of the source first.  The rest is filled by Efraimidis-Spirakis sampling:
document i gets the key -ln(u_i) / w_i with a quality weight w_i, documents are taken
in the order of their keys, and a running sum of words stops at the budget.

Keys come from a digest of the id, so reruns agree.  Running sums are taken inside
buckets of the key (about equally full for weights in [0.25, 1]), to which the sums of
the buckets before are added, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, materialize, query, table

#: Times a document may be used, weights in the order of the sources, buckets of the keys of a source, seed of the keys.
CAP, WEIGHTS, BUCKETS, SEED = 3, (1, 2, 3), 1024, "mix"
#: Characters that count against a text: digits, punctuation and symbols of ASCII.
JUNK = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEAST_WEIGHT = 0.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """In [0.25, 1]: falls with the share of digits, punctuation and symbols; 1 without text."""
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    share = F.when(F.length(text) > 0, junk / F.length(text)).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - 2 * share), F.lit(1.0))


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), by the first 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of every source, null last.

    Sources that reach their cap are those with the smallest cap per weight: the share
    per weight is that of the first source, in this order, that stays below its cap.
    The frame has a row per source, which is all that meets in one place.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", weight.cast("long"))
    order = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rows = per.withColumn("_most", cap * F.col("source_size"))
    level = (total - F.coalesce(F.sum("_most").over(before), F.lit(0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    rows = rows.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") < F.col("_most"))
    # without a free source all are at their caps
    shared = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    target = F.when(F.col("_most") <= shared * F.col("_w"), F.col("_most").cast("double")).otherwise(F.coalesce(shared * F.col("_w"), F.col("_most").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS, kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row, then its columns ``kept``.

    ``taken``: words of the document in the mix, complete epochs included; the last
    document of a source's sample gives only the words still missing.  A null text has
    no words and is never taken; null is a source, the last one; ties of keys and rows
    that repeat are ordered by id, then size, then the columns ``kept``.  An empty table
    gives no rows.  Other columns are not looked at.
    """
    text = F.col(text_col)
    key = -F.log(uniform(F.col(id_col), seed)) / quality_weight(text)
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), key.alias("_key"), *kept)
        # half the rate spreads keys of all weights over the buckets
        .withColumn("_bucket", F.floor(buckets * (1 - F.exp(-F.col("_key") / 2))).cast("int"))
    )
    targets = source_targets(sized, weights, cap)
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sums.withColumn("_before", before).drop("_n").join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumnRenamed("source", "_source").withColumnRenamed("_bucket", "_b")
    inside = F.sum("size").over(Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *kept).rowsBetween(Window.unboundedPreceding, -1))
    rows = sized.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    # a row per source and bucket on this side
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    more = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_before") - F.col("_inside")))
    return rows.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"), *kept)


SIZED = f"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, length(text) AS chars,
         length(text) - length(regexp_replace(text, '[!-@\\[-`{{-~]', '', 'g')) AS junk,
         (('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(greatest(0.25, 1 - 2 * (CASE WHEN chars > 0 THEN junk / chars ELSE 0 END)), 1) AS k FROM sized
)"""
TARGETS = """
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS most FROM per),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::BIGINT - coalesce(sum(most) OVER b, 0)::BIGINT)
            / ((SELECT sum(w) FROM weighed)::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT) AS level
  FROM weighed WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shared AS (SELECT max(level) FILTER (WHERE level * w < most) AS s FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN most <= s * w THEN most::DOUBLE ELSE coalesce(s * w, most::DOUBLE) END AS target FROM levels, shared
)"""
SQL_MIX = f"""
WITH {SIZED.strip()}, {TARGETS.strip()},
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""


@query(SQL_MIX)
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` mixed to weights 1, 2, 3 of their sources."""
    return mix(table(spark, folder, "documents")).drop("source")
