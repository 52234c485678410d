"""URL filter by path templates, in DataFrame functions only.

Urls that a rule decides are the labelled ones.  Per host the paths form a tree of
segments.  At each level a segment that is rare under its parent is a variable and
becomes the wildcard ``*``; frequent siblings are ordered by their share of blocked
urls, and neighbours whose shares do not differ significantly (two proportions,
z = 1.96) become one branch.  The branches of all levels make the template of a url.
A template whose smoothed share of blocked among labelled urls reaches PURITY is
rejected, and with it its urls that no rule decides.

Scale.  Only ids, hosts and paths are shuffled, a level at a time, and counts are
summed before the shuffle.  A node has at most 1 / SHARE frequent children, so the
windows over siblings are small whatever a host's share of the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, UPPER, ascii_lower, materialize, query, table

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its own; the longest wins.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Levels of the tree (what is deeper belongs to the last), urls and share of its parent that make a segment frequent, squared z, weight of one half in the smoothing, share at which a template is rejected.
LEVELS, SUPPORT, SHARE, Z2, PRIOR, PURITY = 4, 5, 0.02, 3.8416, 2, 0.8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _branches(rows: DataFrame) -> DataFrame:
    """(host, template, seg, branch) of the frequent segments; ``rows``: host, template, seg, bad."""
    each = rows.filter("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    nodes = each.groupBy("host", "template").agg(F.sum("n").alias("all"))
    often = each.filter(F.col("n") >= SUPPORT).join(nodes, ["host", "template"]).filter(F.col("n") >= SHARE * F.col("all"))
    order = Window.partitionBy("host", "template").orderBy(F.col("b") / F.col("n"), "seg")
    n2, b2 = F.lag("n").over(order), F.lag("b").over(order)
    pooled = (F.col("b") + F.col("_b2")) / (F.col("n") + F.col("_n2"))
    gap = F.col("b") / F.col("n") - F.col("_b2") / F.col("_n2")
    differs = gap * gap >= Z2 * (pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("_n2")))
    often = often.withColumn("_n2", n2).withColumn("_b2", b2)
    often = often.withColumn("_cut", F.when(F.col("_n2").isNotNull() & (gap != 0) & differs, 1).otherwise(0))
    often = often.withColumn("_g", F.sum("_cut").over(order))
    name = F.array_join(F.sort_array(F.collect_list("seg").over(Window.partitionBy("host", "template", "_g"))), "|")
    return often.select("host", "template", "seg", name.alias("branch"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    A null url or one without ``://`` has empty host and path and is judged like any other.
    Rows that repeat count as often as they occur; an empty table gives no rows; other
    columns are not looked at.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", said)
    rows = rows.withColumn("bad", F.when(F.col("_said") == "block", 1).otherwise(0)).withColumn("template", F.lit(""))
    rows = materialize(rows.withColumn("_segs", F.split(F.regexp_replace("path", "^/", ""), "/", LEVELS)).withColumn("_segs", F.when(F.startswith("path", F.lit("/")), F.col("_segs"))))
    for level in range(LEVELS):
        at = rows.withColumn("seg", F.get("_segs", F.lit(level)))
        if at.filter("seg IS NOT NULL").isEmpty():
            break
        # at most 1 / SHARE rows of a node on this side
        found = at.join(_branches(at), ["host", "template", "seg"], "left")
        step = F.when(F.col("seg").isNotNull(), F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))).otherwise(F.col("template"))
        rows = materialize(found.withColumn("template", step).drop("seg", "branch"))
    labelled = F.when(F.col("_said").isNotNull(), 1).otherwise(0)
    per = rows.groupBy("host", "template").agg(F.sum("bad").alias("_b"), F.sum(labelled).alias("_l"))
    judged = per.select("host", "template", ((F.col("_b") + PRIOR * 0.5) / (F.col("_l") + PRIOR)).alias("purity"))
    verdict = F.coalesce("_said", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return rows.join(judged, ["host", "template"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in longest)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    parts = [f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
),
l0 AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said, CASE WHEN starts_with(path, '/') THEN string_split(path[2:], '/') END AS segs, '' AS template
  FROM parts
)"""]
    for k in range(LEVELS):
        seg = f"segs[{k + 1}]" if k < LEVELS - 1 else f"CASE WHEN len(segs) >= {k + 1} THEN array_to_string(segs[{k + 1}:], '/') END"
        parts.append(f"""
s{k} AS (SELECT *, {seg} AS seg, CASE WHEN said = 'block' THEN 1 ELSE 0 END AS bad FROM l{k}),
e{k} AS (SELECT host, template, seg, count(*) AS n, sum(bad) AS b FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
o{k} AS (
  SELECT *, lag(n) OVER w AS n2, lag(b) OVER w AS b2
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS every FROM e{k})
  WHERE n >= {SUPPORT} AND n >= {SHARE} * every WINDOW w AS (PARTITION BY host, template ORDER BY b / n, seg)
),
c{k} AS (
  SELECT *, CASE WHEN n2 IS NOT NULL AND b / n - b2 / n2 <> 0 AND (b / n - b2 / n2) * (b / n - b2 / n2)
    >= {Z2} * (((b + b2) / (n + n2)) * (1 - (b + b2) / (n + n2)) * (1 / n + 1 / n2)) THEN 1 ELSE 0 END AS cut FROM o{k}
),
g{k} AS (SELECT *, sum(cut) OVER (PARTITION BY host, template ORDER BY b / n, seg) AS g FROM c{k}),
n{k} AS (SELECT host, template, seg, string_agg(seg, '|' ORDER BY seg) OVER (PARTITION BY host, template, g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS branch FROM g{k}),
l{k + 1} AS (
  SELECT s.page_id, s.host, s.path, s.rule, s.said, s.segs,
         CASE WHEN s.seg IS NULL THEN s.template ELSE s.template || '/' || coalesce(n.branch, '*') END AS template
  FROM s{k} s LEFT JOIN n{k} n ON s.host = n.host AND s.template = n.template AND s.seg = n.seg
)""")
    parts.append(f"""
t AS (SELECT host, template, count(*) FILTER (said = 'block') AS b, count(said) AS l FROM l{LEVELS} GROUP BY ALL),
j AS (SELECT host, template, (b + {PRIOR} * 0.5::DOUBLE) / (l + {PRIOR}) AS purity FROM t)
""")
    return ",".join(parts) + f"""
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN j.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, r.template, j.purity
FROM l{LEVELS} r JOIN j ON r.host = j.host AND r.template = j.template"""


@query(_sql())
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every url of ``pages`` judged by the rules and by the templates of its host."""
    return judge(table(spark, folder, "pages"))
