"""Strategies that find a value by its position among the lines of a text.

They work on ``lines`` (array column) inside one row, so they need no shuffle.
``is_label`` and ``pick`` are functions of one line; ``pick`` returns the value
or NULL.  Positions are 0-based like the offsets.

``quick`` is a cheaper test that every label line passes, and the same lines in the form
that it looks at (upper case): only lines that pass it meet ``is_label``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.binding import keep_if, let, let2, regexp_extract
from fieldloom.functions.text import block_between, present, strip
from fieldloom.functions.text import lines as split_lines

LineTest = Callable[[Column], Column]
LinePick = Callable[[Column], Column]
Quick = tuple[Column, LineTest]


def has(*labels: str) -> LineTest:
    """Line contains one of the labels."""

    return lambda line: reduce(Column.__or__, [F.contains(line, F.lit(label)) for label in labels])


def mentions(*labels: str) -> LineTest:
    """Line contains one of the (upper-case) labels in any case."""
    return lambda line: let(F.upper(line), has(*labels))


def word(label: str, pattern: str) -> LineTest:
    """Line matches the pattern; the label in it is looked for first, which is cheaper."""
    return lambda line: F.contains(F.upper(line), F.lit(label)) & matches(pattern)(line)


def equals(label: str, fold: Callable[[Column], Column] | None = None) -> LineTest:
    """Trimmed line equals the label; only a line that contains it is trimmed."""
    folded = fold or (lambda line: line)
    return lambda line: F.contains(folded(line), F.lit(label)) & (folded(strip(line)) == label)


def matches(pattern: str, flags: str = "(?iuU)") -> LineTest:
    return lambda line: F.rlike(line, F.lit(flags + pattern))


def found(pattern: str, group: int = 0, flags: str = "(?U)") -> LinePick:
    """First match in the line."""
    return lambda line: present(regexp_extract(line, F.lit(flags + pattern), F.lit(group)))


def whole(*accept: LineTest) -> LinePick:
    """The trimmed line, when every test accepts it and it is not empty."""

    def usable(value: Column) -> Column:
        ok = value != ""
        for test in accept:
            ok = ok & test(value)
        return ok

    return lambda line: keep_if(strip(line), usable)


def tested(lines: Column, is_label: LineTest, then: Callable[[Column, Column], Column], quick: Quick | None = None) -> Column:
    """``then`` of (is it a label line?, position) for each line."""
    if quick is None:
        return F.transform(lines, lambda line, i: then(is_label(line), i))
    shown, may = quick
    return F.transform(shown, lambda line, i: then(may(line) & is_label(F.get(lines, i)), i))


def first_index(lines: Column, is_label: LineTest, quick: Quick | None = None) -> Column:
    """Position of the first label line, NULL without one."""
    where = F.array_position(tested(lines, is_label, lambda ok, i: F.coalesce(ok, F.lit(False)), quick), True)
    return let(where, lambda w: F.when(w > 0, (w - 1).cast("int")))


def last_index(lines: Column, is_label: LineTest) -> Column:
    marks = F.transform(lines, lambda x: F.coalesce(is_label(x), F.lit(False)))
    back = F.array_position(F.reverse(marks), True)
    return let(back, lambda b: F.when(b > 0, (F.size(lines) - b).cast("int")))


def at(lines: Column, position: Column) -> Column:
    """Line at a position; NULL before the start or after the end."""
    return F.when(position >= 0, F.get(lines, position))


def first_value(values: Column) -> Column:
    """First non-NULL element."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def label_offset(lines: Column, is_label: LineTest, offsets: list[int], pick: LinePick, first_only: bool = True,
                 quick: Quick | None = None) -> Column:
    """Value ``offset`` lines after a label; offsets are tried in order.

    ``first_only`` stops at the first label line, otherwise later label lines are
    tried too.
    """
    if first_only:
        return let(first_index(lines, is_label, quick), lambda i: F.coalesce(*[pick(at(lines, i + k)) for k in offsets]))
    return first_value(tested(lines, is_label, lambda ok, i: F.when(ok, F.coalesce(*[pick(at(lines, i + k)) for k in offsets])), quick))


def window_values(lines: Column, position: Column, first: int, last: int, pick: LinePick) -> Column:
    """Values of the lines ``position+first .. position+last``."""
    start = F.greatest(position + first, F.lit(0))
    count = F.greatest(position + last - start + 1, F.lit(0))
    part = F.when(position.isNotNull(), F.slice(lines, start + 1, count))
    return F.filter(F.transform(part, pick), lambda v: v.isNotNull())


def label_window(lines: Column, is_label: LineTest, first: int, last: int, pick: LinePick,
                 which: str = "first", first_only: bool = True, quick: Quick | None = None) -> Column:
    """First or last acceptable value in a window after a label."""

    def choose(values: Column) -> Column:
        return F.get(values, F.lit(0)) if which == "first" else F.try_element_at(values, F.lit(-1))

    if first_only:
        return let(first_index(lines, is_label, quick), lambda i: F.when(i.isNotNull(), choose(window_values(lines, i, first, last, pick))))
    return first_value(tested(lines, is_label, lambda ok, i: F.when(ok, choose(window_values(lines, i, first, last, pick))), quick))


def label_inline(lines: Column, pattern: str, group: int = 1, flags: str = "(?iuU)", accept: LineTest | None = None) -> Column:
    """First line on which the pattern yields an acceptable value."""

    def pick(line: Column) -> Column:
        value = strip(regexp_extract(line, flags + pattern, group))
        return keep_if(value, lambda v: (v != "") if accept is None else (v != "") & accept(v))

    return first_value(F.transform(lines, pick))


def line_matches(lines: Column, pattern: str, group: int = 1, flags: str = "(?U)") -> Column:
    """First match of every line that has one, for a vote."""
    values = F.transform(lines, lambda x: present(regexp_extract(x, F.lit(flags + pattern), F.lit(group))))
    return F.filter(values, lambda v: v.isNotNull())


def section(text: Column, start: str, end: str) -> Column:
    """Text of a section between two anchor patterns, trimmed."""
    return strip(block_between(text, start, end))


def section_bounds(lines: Column, start: LineTest, end: LineTest, quick: Quick | None = None) -> Column:
    """(start, end) positions: the first end line and the last start line up to it.  ``quick`` is for the end line."""

    def bounds(stop: Column) -> Column:
        head = F.slice(lines, 1, F.coalesce(stop + 1, F.lit(0)))
        return let(last_index(head, start), lambda begin: F.when(begin.isNotNull(), F.struct(begin.alias("start"), stop.alias("end"))))

    return let(first_index(lines, end, quick), lambda stop: F.when(stop.isNotNull(), bounds(stop)))


def section_lines(lines: Column, start: LineTest, end: LineTest, quick: Quick | None = None) -> Column:
    """Lines of the section, start line included, end line not."""
    part = lambda b: F.when(b.isNotNull(), F.slice(lines, b["start"] + 1, b["end"] - b["start"]))
    return let(section_bounds(lines, start, end, quick), part)


def between_anchors(lines: Column, is_label: LineTest, opens: LineTest, closes: LineTest, max_lines: int = 15) -> Column:
    """Lines between an opening and a closing line, after a label, joined by a blank.

    The last opening line before the first closing line counts.
    """

    return first_value(F.transform(lines, lambda line, i: F.when(is_label(line), between_at(lines, i, opens, closes, max_lines))))


def between_at(lines: Column, position: Column, opens: LineTest, closes: LineTest, max_lines: int) -> Column:
    """Lines between an opening and a closing line from one position on."""

    def cut(part: Column, stop: Column) -> Column:
        start = last_index(F.slice(part, 1, F.coalesce(stop, F.lit(0))), opens)
        held = let(start, lambda s: F.filter(F.slice(part, s + 2, F.greatest(stop - s - 1, F.lit(0))), lambda x: x != ""))
        return present(F.array_join(held, " "))

    part = F.transform(F.slice(lines, position + 1, max_lines), strip)
    return let(part, lambda p: let(first_index(p, closes), lambda stop: cut(p, stop)))


def relative_to(lines: Column, other: Column, offset: int, pick: LinePick = whole()) -> Column:
    """Value ``offset`` lines from the first line that holds another field's value."""

    def near(value: Column) -> Column:
        i = first_index(lines, lambda line: F.contains(line, value))
        return F.when(value != "", pick(at(lines, i + offset)))

    return let(other, near)


def line_before(lines: Column, other: Column) -> Column:
    """Line before the first line, not being the very first, that holds another value."""

    def before(all_lines: Column, value: Column) -> Column:
        tried = F.transform(all_lines, lambda line, i: F.when(F.contains(line, value) & (i > 0), strip(F.get(all_lines, i - 1))))
        return F.when(value != "", first_value(tried))

    return let2(lines, other, before)


def label_steps(lines: Column, is_label: LineTest, steps: list[Callable[[Column, Column], Column]], first_only: bool = False,
                quick: Quick | None = None) -> Column:
    """Several ways to a value, all tried at one label line before the next.

    A step is a function of (lines, position).
    """
    if first_only:
        return let(first_index(lines, is_label, quick), lambda i: F.when(i.isNotNull(), F.coalesce(*[s(lines, i) for s in steps])))
    return first_value(tested(lines, is_label, lambda ok, i: F.when(ok, F.coalesce(*[s(lines, i) for s in steps])), quick))


def step_at(offset: int, pick: LinePick) -> Callable[[Column, Column], Column]:
    return lambda lines, i: pick(at(lines, i + offset))


def step_window(first: int, last: int, pick: LinePick, which: str = "first") -> Callable[[Column, Column], Column]:
    def step(lines: Column, i: Column) -> Column:
        values = window_values(lines, i, first, last, pick)
        return F.get(values, F.lit(0)) if which == "first" else F.try_element_at(values, F.lit(-1))

    return step


def last_found(pattern: str, flags: str = "(?U)") -> LinePick:
    """Last match in the line."""

    def pick(line: Column) -> Column:
        return F.try_element_at(F.regexp_extract_all(line, F.lit(flags + pattern), F.lit(0)), F.lit(-1))

    return pick


def from_block_end(lines: Column, back: int, pick: LinePick = whole()) -> Column:
    """Value ``back`` lines before the end of a block."""
    return let(lines, lambda block: pick(at(block, F.size(block) - back)))


def context_before(lines: Column, position: Column, back: int, test: LineTest) -> Column:
    """Does one of the ``back`` lines before the position pass the test?"""
    start = F.greatest(position - back, F.lit(0))
    part = F.transform(F.slice(lines, start + 1, F.greatest(position - start, F.lit(0))), strip)
    return F.exists(part, test)


def context_window(lines: Column, is_label: LineTest, first: int, last: int, back: int, context: LineTest) -> Column:
    """First line in the window whose preceding lines pass the context test."""

    def search(block: Column) -> Column:
        def inside(position: Column) -> Column:
            steps = [
                F.when(context_before(block, position + k, back, context), strip(at(block, position + k)))
                for k in range(first, last + 1)
            ]
            return F.coalesce(*steps)

        return first_value(F.transform(block, lambda line, i: F.when(is_label(line), inside(i))))

    return let(lines, search)


def penultimate_line(lines: Column, back: int, context: LineTest) -> Column:
    """Last line but one of a block, when the lines before it pass the test."""

    def take(block: Column) -> Column:
        position = F.size(block) - 2
        return F.when((position >= 0) & context_before(block, position, back, context), strip(at(block, position)))

    return let(lines, take)


def numbered_block(text: Column, anchor: str, is_key: LineTest, length: int = 400) -> Column:
    """(key, name): first key line after an anchor and the line before it."""
    rest_of_text = F.get(F.split(text, f"\\Q{anchor}\\E", 2), F.lit(1))  # NULL without the anchor
    after_anchor = lambda rest: F.left(F.concat(F.lit(anchor), rest), F.lit(length))
    part = let(rest_of_text, lambda rest: F.filter(F.transform(split_lines(after_anchor(rest)), strip), lambda x: x != ""))

    def pair(rest: Column, i: Column) -> Column:
        return F.when(i.isNotNull(), F.struct(F.get(rest, i).alias("key"), F.when(i > 0, F.get(rest, i - 1)).alias("name")))

    after = let(part, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    return let(after, lambda rest: let(first_index(rest, is_key), lambda i: pair(rest, i)))


def without(value: Column, excluded: list[str], fold: Callable[[Column], Column] = F.lower) -> Column:
    """NULL when the value is one of the excluded ones."""
    return keep_if(value, lambda v: ~fold(v).isin(*excluded))


def first_of(*candidates: Column, default: str | None = None) -> Column:
    """Cascade: first strategy that gave a value."""
    return F.coalesce(*candidates, *([F.lit(default)] if default is not None else []))


def constant_if(test: Column, value: str) -> Column:
    """A word in the text decides the value at once."""
    return F.when(test, F.lit(value))


def table_offsets(lines: DataFrame, labels: Column, offsets: dict[str, int]) -> DataFrame:
    """Label lines with the lines at some offsets as columns, from the line table.

    Where ``line_table`` gave the lines at these offsets (``ahead``), only label lines are
    grouped; else one join on (document, line number) finds them.
    """
    if "ahead" in lines.columns:
        found = lines.filter(labels).select(
            "doc_id", F.col("line_no").alias("_label_no"), F.col("line").alias("_label"), *[F.col("ahead")[str(k)].alias(name) for name, k in offsets.items()]
        )
        columns = [F.max(name).alias(name) for name in offsets]
    else:
        items = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("k")) for name, k in offsets.items()])
        wanted = lines.filter(labels).select("doc_id", F.col("line_no").alias("_label_no"), F.col("line").alias("_label"), F.inline(items))
        wanted = wanted.select("doc_id", "_label_no", "_label", "name", (F.col("_label_no") + F.col("k")).alias("line_no"))
        found = wanted.join(lines, ["doc_id", "line_no"], "left")
        columns = [F.max(F.when(F.col("name") == name, F.col("line"))).alias(name) for name in offsets]
    # the lines of texts under one id count together
    grouped = found.groupBy("doc_id", "_label_no", "_label").agg(*columns)
    return grouped.select("doc_id", F.col("_label").alias("line"), *offsets)


def line_table(docs: DataFrame, text: str = "text", ahead: list[int] | None = None) -> DataFrame:
    """(doc_id, line_no, line[, ahead]): table form, for joins and votes over many lines.

    ``ahead``: offsets whose lines travel with each line, as a struct with a field for each offset.
    """
    held = docs.select("doc_id", split_lines(F.col(text)).alias("_lines"))
    # the outer form keeps the optimizer from splitting the text a second time in a filter of its own
    rows = held.select("doc_id", "_lines", F.posexplode_outer("_lines").alias("line_no", "line")).filter(F.col("line_no").isNotNull())
    others = [F.struct(*[at(F.col("_lines"), F.col("line_no") + k).alias(str(k)) for k in ahead]).alias("ahead")] if ahead else []
    return rows.select("doc_id", "line_no", "line", *others)
