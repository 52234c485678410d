"""Geometry: values found by their place on the page.

Array functions take the spans of one document (``ARRAY<STRUCT<page, ord, block,
line, text, x0, y0, x1, y1, ...>>``); table functions take one row per span.
The table functions look values up in a grid: a span lies in one cell (document,
page, band of the height), a label or section probes the cells its reach touches
and a zone those of its product and page.  So each lookup is an equi-join on cells,
however many spans a page or zones a product has; pairs are aggregated in part
before they are shuffled, no page is collected anywhere.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.binding import keep_if, let, regexp_extract
from fieldloom.functions.text import present, strip
from fieldloom.operators.bounds import join_small

PAGE = ["doc_id", "page"]
CELL = 50.0  # height of a band of the grid, in points
TALLEST = 14_400.0  # what lies further down shares the last cell
ZONE_BANDS = 20  # bands of a page for zones, whose bounds are fractions of its height
ZONE_PAD = 5.0
SAME_LINE = 3  # spans whose tops differ by no more stand in one line


# ---- flattening ---------------------------------------------------------------

def flatten_spans(pages: DataFrame) -> DataFrame:
    """Pages with nested blocks -> one row per non-empty span, in reading order.

    ``pages``: doc_id, page, blocks ARRAY<STRUCT<lines:ARRAY<STRUCT<spans:ARRAY<STRUCT<text,bbox>>>>>>.
    """
    blocks = pages.select(*PAGE, F.posexplode("blocks").alias("block", "_b"))
    lines = blocks.select(*PAGE, "block", F.posexplode("_b.lines").alias("line", "_l"))
    spans = lines.select(*PAGE, "block", "line", F.posexplode("_l.spans").alias("span", "_s"))
    return spans.filter(strip(F.col("_s.text")) != "").select(
        *PAGE, "block", "line", "span",
        (F.col("block").cast("bigint") * 2**40 + F.col("line").cast("bigint") * 2**20 + F.col("span")).alias("ord"),
        strip(F.col("_s.text")).alias("text"),
        *[F.get("_s.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
    )


# ---- array form ---------------------------------------------------------------

def find_label(spans: Column, label: str, exact: bool = False) -> Column:
    """First span in reading order that holds (or equals) the label, case-blind."""
    low = label.lower()
    test = (lambda s: F.lower(s["text"]) == low) if exact else (lambda s: F.contains(F.lower(s["text"]), F.lit(low)))
    return F.get(F.filter(spans, test), F.lit(0))


def band(spans: Column, y0: Column, y1: Column) -> Column:
    """Spans that start in [y0, y1)."""
    return F.filter(spans, lambda s: (s["y0"] >= y0) & (s["y0"] < y1))


def on_page(spans: Column, page: Column | int) -> Column:
    return F.filter(spans, lambda s: s["page"] == page)


def _others(spans: Column, label: Column, exclude: list[str]) -> Column:
    return F.filter(
        spans,
        lambda s: (s["page"] == label["page"]) & (s["ord"] != label["ord"])
        & (~F.lower(s["text"]).isin(*exclude) if exclude else F.lit(True)),
    )


def nearest_value(spans: Column, label: Column, exclude: list[str] | None = None, tol_x: float = 14, tol_row: float = 3,
                  max_dy: float = 45, same_row: bool = True, below: bool = True, max_dx: float | None = None) -> Column:
    """Value right of the label in its row, else the nearest one below in its column."""

    def beside(s: Column, mark: Column) -> Column:
        right = (F.abs(s["y0"] - mark["y0"]) <= tol_row) & (s["x0"] > mark["x1"] - 2)
        return right & (s["x0"] - mark["x1"] <= max_dx) if max_dx is not None else right

    def under(s: Column, mark: Column) -> Column:
        dy = s["y0"] - mark["y0"]
        return (dy > 0) & (dy <= max_dy) & (F.abs(s["x0"] - mark["x0"]) <= tol_x)

    places = [test for test, wanted in ((beside, same_row), (under, below)) if wanted]

    def ranked(s: Column, mark: Column) -> Column:
        right = beside(s, mark) if same_row else F.lit(False)
        gap = F.when(right, s["x0"] - mark["x1"]).otherwise(s["y0"] - mark["y0"])
        return F.struct(F.when(right, 0).otherwise(1).alias("kind"), gap.alias("gap"), s["ord"].alias("ord"), s["text"].alias("text"))

    def best(mark: Column) -> Column:
        # the place is tested first: only the few spans that pass are looked at further
        near = F.filter(spans, lambda s: reduce(or_, (test(s, mark) for test in places), F.lit(False)))
        held = _others(near, mark, exclude or [])
        return present(strip(F.array_min(F.transform(held, lambda s: ranked(s, mark)))["text"]))

    return let(label, lambda mark: F.when(mark.isNotNull(), best(mark)))


def column_lines(spans: Column, label: Column, exclude: list[str] | None = None, tol_x: float = 14, max_dy: float = 90,
                 max_lines: int = 4, max_gap: float = 20) -> Column:
    """Lines below the label in its column, up to the first large gap, joined by a blank."""

    def below(mark: Column) -> Column:
        under = F.filter(
            _others(spans, mark, exclude or []),
            lambda s: (s["y0"] > mark["y0"]) & (s["y0"] - mark["y0"] <= max_dy) & (F.abs(s["x0"] - mark["x0"]) <= tol_x),
        )
        keyed = F.transform(under, lambda s: F.struct(s["y0"].alias("y"), s["ord"].alias("o"), s["text"].alias("t")))
        return let(F.slice(F.array_sort(keyed), 1, max_lines), lambda ordered: join_until_gap(ordered, max_gap))

    return let(label, lambda mark: F.when(mark.isNotNull(), present(below(mark))))


def join_until_gap(ordered: Column, max_gap: float) -> Column:
    """Texts (y, o, t) from the top until a vertical gap, joined by a blank."""
    kept = F.filter(
        ordered,
        lambda s, i: ~F.exists(
            F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))),
            lambda j: (j < i) & (F.get(ordered, j + 1)["y"] - F.get(ordered, j)["y"] > max_gap),
        ),
    )
    return F.array_join(F.filter(F.transform(kept, lambda s: strip(s["t"])), lambda t: t != ""), " ")


def over_pages(spans: Column, label: str, pages: Column | None, value, kind: str = "string") -> Column:
    """First page whose label gives a value; no page after it is looked at.

    ``value``: (page spans, label span) -> Column of type ``kind``.
    """
    numbers = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["page"]))) if pages is None else pages

    def on(page: Column) -> Column:
        return let(on_page(spans, page), lambda part: value(part, find_label(part, label)))

    return F.aggregate(numbers, F.lit(None).cast(kind), lambda found, page: F.coalesce(found, on(page)))


def after_label_in_line(spans: Column, label: str, pick) -> Column:
    """First usable span after the label within the same text line."""
    low = label.lower()

    def after(hit: Column) -> Column:
        rest = F.filter(
            spans,
            lambda s: (s["page"] == hit["page"]) & (s["block"] == hit["block"]) & (s["line"] == hit["line"]) & (s["ord"] > hit["ord"]),
        )
        return F.get(F.filter(F.transform(rest, lambda s: pick(s["text"])), lambda v: v.isNotNull()), F.lit(0))

    hits = F.filter(spans, lambda s: F.contains(F.lower(s["text"]), F.lit(low)))
    return F.get(F.filter(F.transform(hits, after), lambda v: v.isNotNull()), F.lit(0))


def layout_lines(spans: Column) -> Column:
    """(page, block, line, text) in reading order, spans joined by a blank."""
    keyed = F.transform(spans, lambda s: F.struct(s["page"].alias("page"), s["block"].alias("block"), s["line"].alias("line")))
    return F.transform(
        F.array_distinct(keyed),
        lambda k: F.struct(
            k["page"].alias("page"), k["block"].alias("block"), k["line"].alias("line"),
            F.array_join(
                F.transform(
                    F.filter(spans, lambda s: (s["page"] == k["page"]) & (s["block"] == k["block"]) & (s["line"] == k["line"])),
                    lambda s: s["text"],
                ),
                " ",
            ).alias("text"),
        ),
    )


def table_row(rows: Column, words: list[str], pattern: str, accept, group: int = 1) -> Column:
    """Value in the header row that holds all words, else in the next line of its block.

    ``rows`` comes from ``layout_lines``.
    """

    def one(row: Column, i: Column, rs: Column) -> Column:
        header = F.lit(True)
        for w in words:
            header = header & F.contains(F.lower(row["text"]), F.lit(w))
        inline = regexp_extract(row["text"], "(?iuU)" + pattern, group)
        following = F.get(rs, i + 1)
        below = F.when((following["page"] == row["page"]) & (following["block"] == row["block"]), strip(following["text"]))
        usable = lambda v: (v != "") & accept(v)
        return F.when(header, F.coalesce(keep_if(inline, usable), keep_if(below, usable)))

    return let(rows, lambda rs: F.get(F.filter(F.transform(rs, lambda r, i: one(r, i, rs)), lambda v: v.isNotNull()), F.lit(0)))


def in_zone(y0: Column, y1: Column, height: Column, top: Column, bottom: Column, pad: float = ZONE_PAD) -> Column:
    """Does a span lie in the full-width band between two fractions of its page's height?"""
    return (y0 >= F.greatest(F.lit(0.0), top * height - pad)) & (y1 <= F.least(height, bottom * height + pad))


def zone_lines(spans: Column) -> Column:
    """Text of spans in reading order, one text line per distinct height."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1))
    return F.aggregate(
        ordered,
        F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("y")),
        lambda acc, s: F.struct(
            F.when(acc["y"].isNull(), s["text"])
            .when(F.abs(acc["y"] - s["y0"]) <= SAME_LINE, F.concat(acc["t"], F.lit(" "), s["text"]))
            .otherwise(F.concat(acc["t"], F.lit("\n"), s["text"])).alias("t"),
            s["y0"].alias("y"),
        ),
        lambda acc: acc["t"],
    )


def zone_text(spans: Column, bbox: Column, pad: float = ZONE_PAD) -> Column:
    """Text of the full-width band of one page between two fractions of its height."""
    inside = lambda s: (s["page"] == bbox["page"]) & in_zone(s["y0"], s["y1"], s["page_height"], bbox["top"], bbox["bottom"], pad)
    return zone_lines(F.filter(spans, inside))


# ---- table form ---------------------------------------------------------------

SPAN = ["doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1"]


def label_spans(spans: DataFrame, label: str, exact: bool = False, y_from: str | None = None, y_to: str | None = None) -> DataFrame:
    """First span per page that holds the label, optionally inside [y_from, y_to)."""
    low = F.lower("text")
    hit = spans.filter(low == label.lower() if exact else F.contains(low, F.lit(label.lower())))
    if y_from is not None:
        hit = hit.filter(F.col("y0") >= F.col(y_from))
    if y_to is not None:
        hit = hit.filter(F.col("y0") < F.col(y_to))
    first = hit.groupBy(*PAGE).agg(F.min_by(F.struct("ord", "x0", "y0", "x1", "y1"), "ord").alias("_l"))
    return first.select(*PAGE, *[F.col(f"_l.{c}").alias(f"l_{c}") for c in ("ord", "x0", "y0", "x1", "y1")])


def _cell(y: Column) -> Column:
    return F.floor(F.least(F.greatest(y, F.lit(0.0)), F.lit(TALLEST)) / CELL)


def within_reach(spans: DataFrame, marks: DataFrame, low: Column, high: Column) -> DataFrame:
    """Spans with the marks (doc_id, page, ...) of their page between whose ``low`` and ``high`` they start.

    ``low`` and ``high`` are columns of the mark, both inclusive; without one of them it reaches nothing.
    """
    probes = marks.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= F.col("_high"))
    probes = probes.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_low")), _cell(F.col("_high")))))
    met = spans.withColumn("_cell", _cell(F.col("y0"))).join(probes, [*PAGE, "_cell"])
    return met.filter((F.col("y0") >= F.col("_low")) & (F.col("y0") <= F.col("_high"))).drop("_cell", "_low", "_high")


def nearest_values(spans: DataFrame, labels: DataFrame, exclude: list[str] | None = None, tol_x: float = 14,
                   tol_row: float = 3, max_dy: float = 45, same_row: bool = True, below: bool = True,
                   max_dx: float | None = None) -> DataFrame:
    """(doc_id, page, value) for each label span; partial aggregation before the shuffle."""
    above, beneath = (tol_row if same_row else 0), max(tol_row if same_row else 0, max_dy if below else 0)
    pairs = within_reach(spans, labels, F.col("l_y0") - above, F.col("l_y0") + beneath).filter(F.col("ord") != F.col("l_ord"))
    if exclude:
        pairs = pairs.filter(~F.lower("text").isin(*exclude))
    dy, dx = F.col("y0") - F.col("l_y0"), F.col("x0") - F.col("l_x1")
    right = (F.abs(dy) <= tol_row) & (F.col("x0") > F.col("l_x1") - 2)
    if max_dx is not None:
        right = right & (dx <= max_dx)
    under = (dy > 0) & (dy <= max_dy) & (F.abs(F.col("x0") - F.col("l_x0")) <= tol_x)
    kind = F.when(right & F.lit(same_row), 0).when(under & F.lit(below), 1)
    placed = pairs.withColumn("_k", kind).filter(F.col("_k").isNotNull())
    gap = F.when(F.col("_k") == 0, dx).otherwise(dy)
    return placed.groupBy(*PAGE).agg(F.min_by("text", F.struct("_k", gap, "ord")).alias("value"))


def first_page_value(values: DataFrame) -> DataFrame:
    """Value of the first page of each document that has one."""
    return values.filter(F.coalesce("value", F.lit("")) != "").groupBy("doc_id").agg(F.min_by("value", "page").alias("value"))


def column_values(spans: DataFrame, labels: DataFrame, exclude: list[str] | None = None, tol_x: float = 14,
                  max_dy: float = 90, max_lines: int = 4, max_gap: float = 20) -> DataFrame:
    """Table form of ``column_lines``: at most a few spans per label survive the band filter."""
    pairs = within_reach(spans, labels, F.col("l_y0"), F.col("l_y0") + max_dy).filter(F.col("ord") != F.col("l_ord"))
    dy = F.col("y0") - F.col("l_y0")
    under = pairs.filter((dy > 0) & (dy <= max_dy) & (F.abs(F.col("x0") - F.col("l_x0")) <= tol_x))
    if exclude:
        under = under.filter(~F.lower("text").isin(*exclude))
    # the spans of one label column within max_dy points: bounded by the geometry
    held = under.groupBy(*PAGE).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.col("y0").alias("y"), F.col("ord").alias("o"), F.col("text").alias("t")))), 1, max_lines).alias("_s")
    )
    return held.select(*PAGE, join_until_gap(F.col("_s"), max_gap).alias("value"))


def section_spans(spans: DataFrame, start: DataFrame, end: DataFrame, default_height: float = 200) -> DataFrame:
    """Spans from the start label up to the end label, or ``default_height`` points."""
    bounds = start.select(*PAGE, F.col("l_y0").alias("_from")).join(end.select(*PAGE, F.col("l_y0").alias("_to")), PAGE, "left")
    bounds = bounds.select(*PAGE, "_from", F.coalesce("_to", F.col("_from") + default_height).alias("_to"))
    return within_reach(spans, bounds, F.col("_from"), F.col("_to")).filter(F.col("y0") < F.col("_to")).drop("_from", "_to")


def band_below_title(spans: DataFrame, title: str, height: float = 40) -> DataFrame:
    """Spans just below a title on the last page that has it."""
    hit = spans.filter(F.col("text") == title)
    last = hit.groupBy("doc_id").agg(F.min_by(F.struct("page", "y0"), F.struct(-F.col("page"), "ord")).alias("_t"))
    last = last.select("doc_id", F.col("_t.page").alias("_page"), F.col("_t.y0").alias("_y"))
    # A document has one such title, so a join on the document pairs no span twice.  Its spans are sent side by side
    # and without a cell, which packs them well, and what is grouped by document afterwards is not sent again.
    below = (F.col("page") == F.col("_page")) & (F.col("y0") > F.col("_y")) & (F.col("y0") <= F.col("_y") + height)
    return spans.join(last, "doc_id").filter(below).select(*PAGE, *[c for c in spans.columns if c not in PAGE])


def _zone_band(fraction: Column) -> Column:
    return F.floor(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * ZONE_BANDS)


def zone_texts(spans: DataFrame, zones: DataFrame, pad: float = ZONE_PAD) -> DataFrame:
    """(rule_id, doc_id, text) of zones given as fractions of the page height, full width: the table form of ``zone_text``.

    ``zones``: rule_id, [product_id,] page, top, bottom; ``spans`` need page_height and, when zones belong to products,
    product_id.  A zone without spans gives no row.
    """
    of = [c for c in ("product_id", "page") if c in zones.columns]
    y0, y1, height = F.col("y0"), F.col("y1"), F.col("page_height")
    # a span reaches a zone where [least(start, end), start] meets [top, bottom]; the margin covers rounding
    start, end = (y0 + pad) / height, (y1 - pad) / height
    first, last = _zone_band(F.least(start, end) - 1e-9), _zone_band(start + 1e-9)
    placed = spans.withColumn("_first", first).withColumn("_band", F.explode(F.sequence("_first", last)))
    # a missing bound is the page's edge
    edges = F.coalesce("top", F.lit(0.0)), F.coalesce("bottom", F.lit(1.0))
    probes = zones.select("rule_id", *of, "top", "bottom", _zone_band(F.least(*edges)).alias("_low"), _zone_band(F.greatest(*edges)).alias("_high"))
    probes = probes.withColumn("_band", F.explode(F.sequence("_low", "_high"))).drop("_high")
    met = join_small(placed, probes, [*of, "_band"]).filter(F.col("_band") == F.greatest("_first", "_low"))  # once, in the first band they share
    inside = met.filter(in_zone(y0, y1, height, F.col("top"), F.col("bottom"), pad))
    # spans of one zone of one page: bounded by the page
    grouped = inside.groupBy("rule_id", "doc_id").agg(F.collect_list(F.struct("ord", "y0", "text")).alias("_s"))
    return grouped.select("rule_id", "doc_id", zone_lines(F.col("_s")).alias("text"))
