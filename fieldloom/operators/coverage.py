"""Rule coverage, pattern tests, audits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.literals import literals_column
from fieldloom.functions.regex import apply_pattern, compiles, is_valid, prepare_column, search
from fieldloom.operators.bounds import rows_within
from fieldloom.operators.fields import usable_rules
from fieldloom.operators.terms import pattern_hits
from fieldloom.session import materialize


def rule_coverage(fields: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fields per product, how many are covered by a rule or fixed value, percent.

    ``fields`` from ``product_fields`` (``dedupe=False`` counts a name listed twice
    twice).  ``keys``: further grouping columns of ``fields``.
    """
    keys = keys or ["product_id"]
    return _coverage(flag_covered(fields, rules).groupBy(*keys))


def flag_covered(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields with a flag: a fixed value or an active rule covers them."""
    named = usable_rules(rules).select("product_id", "field").distinct().withColumn("_rule", F.lit(True))
    joined = fields.join(named, ["product_id", "field"], "left")
    covered = F.col("_rule").isNotNull() | (F.col("is_global") & F.col("fixed_value").isNotNull())
    return joined.withColumn("covered", F.coalesce(covered, F.lit(False))).drop("_rule")


def covered_first() -> list[Column]:
    """Order of a field list: covered fields first, then by their number."""
    return [F.desc("covered"), F.asc_nulls_last("order")]


def global_first() -> list[Column]:
    """Order of a field list: global fields first, then by their number."""
    return [F.desc("is_global"), F.asc_nulls_last("order")]


def _coverage(grouped) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("total") - F.col("covered"))).withColumn(
        "percent", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total") * 100, 1)).otherwise(0.0)
    )


def coverage_rollup(fields: DataFrame, rules: DataFrame, levels: list[str]) -> DataFrame:
    """Coverage at every level of the hierarchy and in total."""
    return _coverage(flag_covered(fields, rules).rollup(*levels))


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """(product, field) with more than one active rule; empty when all is well."""
    return usable_rules(rules).groupBy("product_id", "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_names(catalogue: DataFrame) -> DataFrame:
    """Company names used more than once."""
    return catalogue.filter(F.col("level") == m.COMPANY).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def test_pattern(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Per document: value, found flag, reason when there is no text."""
    value = apply_pattern(F.col(text), pattern)
    no_text = F.coalesce(F.length(text), F.lit(0)) == 0
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.when(~no_text, value).alias("value"),
        F.coalesce(~no_text & value.isNotNull(), F.lit(False)).alias("found"),
        F.when(no_text, F.lit("no text")).alias("error"),
    )


test_pattern.__test__ = False


def batch_summary(tested: DataFrame, keys: list[str]) -> DataFrame:
    """Found and total per batch, and whether all were found."""
    return tested.groupBy(*keys).agg(
        F.count_if("found").alias("found"), F.count(F.lit(1)).alias("total"), F.every("found").alias("passes")
    )


def pattern_counts(docs: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Number of texts each pattern occurs in: one pass, one row per pattern."""
    distinct = list(dict.fromkeys(patterns))
    counts = docs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(search(F.col(text), p), F.lit(False))).alias(f"c{i}") for i, p in enumerate(distinct)],
    )
    rows = F.array(
        *[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("matches"), F.col("total"), F.lit(is_valid(p)).alias("valid"))
          for i, p in enumerate(distinct)]
    )
    return counts.select(F.inline(rows))


def pattern_counts_from(docs: DataFrame, patterns: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """As ``pattern_counts`` for a table of patterns of any size (beyond ``limit``: through ``pattern_hits``; ids of ``docs`` are unique)."""
    distinct = patterns.select(F.col(column).alias("pattern")).filter(F.col(column).isNotNull()).distinct()
    rows = rows_within(distinct, limit)
    if rows is not None:
        return pattern_counts(docs, [r[0] for r in rows])
    listed = materialize(distinct.withColumn("valid", compiles("pattern")).withColumn("literals", literals_column("pattern")).withColumn("java", prepare_column("pattern")["java"])
                         .withColumn("term_id", F.monotonically_increasing_id()))
    hits = pattern_hits(docs.select("doc_id", "text"), listed.filter(F.col("java").isNotNull()).select("term_id", "java", "literals"))
    n = hits.groupBy("term_id").agg(F.count(F.lit(1)).alias("matches"))
    return listed.join(n, "term_id", "left").select("pattern", F.coalesce("matches", F.lit(0)).alias("matches"), F.lit(docs.count()).alias("total"), "valid")


def queue_counters(queue: DataFrame) -> DataFrame:
    """Counts by state and confidence."""
    state, conf = F.col("state"), F.col("confidence")
    ready = (state == m.CLASSIFIED) & (conf == m.HIGH)
    review = state.isin(m.NEEDS_PERSON, m.CLASSIFIED) & (F.coalesce(conf, F.lit("")) != m.HIGH)
    return queue.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ready).alias("high"),
        F.count_if(review).alias("review"),
        F.count_if(state == m.SENT).alias("sent"),
        F.count_if(state == m.FAILED).alias("failed"),
        F.count_if(ready).alias("batch_ready"),
    )


def quality_flags(results: DataFrame) -> DataFrame:
    """Per document: ok, failed, unrecognised, new patterns, low confidence, no product."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    known = F.coalesce(F.col("company"), F.lit("")) != ""
    return results.select(
        "*",
        (~failed).alias("ok"),
        failed.alias("failed"),
        (~known & ~failed).alias("unrecognised"),
        F.coalesce(F.col("new_patterns"), F.lit(False)).alias("with_new_patterns"),
        (known & F.coalesce(F.col("confidence").isin(m.LOW, m.NO_DATA), F.lit(False))).alias("low_confidence"),
        (known & (F.coalesce(F.col("product"), F.lit("")) == "") & ~failed).alias("without_product"),
    )


FLAGS = ["ok", "failed", "unrecognised", "with_new_patterns", "low_confidence", "without_product"]


def flag_totals(flagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return flagged.groupBy(*(keys or [])).agg(*[F.count_if(f).alias(f) for f in FLAGS])


def patterns_per_company(catalogue: DataFrame) -> DataFrame:
    """Patterns of a company with its lines and products."""
    size = F.greatest(F.coalesce(F.size("patterns"), F.lit(0)), F.lit(0)).alias("n")
    level = lambda lv: catalogue.filter((F.col("level") == lv) & F.col("active")).select("id", "parent_id", "name", size)
    company, line, product = level(m.COMPANY), level(m.LINE), level(m.PRODUCT)
    line_to_company = line.select(F.col("id").alias("_line"), F.col("parent_id").alias("_company"))
    of_products = product.join(line_to_company, F.col("parent_id") == F.col("_line")).select(F.col("_company").alias("id"), "n")
    of_lines = line.select(F.col("parent_id").alias("id"), "n")
    total = company.select("id", "n").unionByName(of_lines).unionByName(of_products).groupBy("id").agg(F.sum("n").alias("n_patterns"))
    return company.select("id", "name").join(total, "id")
