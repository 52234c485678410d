"""Readers, writers, answers, streams."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

import samples
from fieldloom import model as m
from fieldloom.operators import upkeep
from fieldloom.plans.recipes import run_extractor
from fieldloom.sources import export, history, ingest, snapshots
from fieldloom.streaming import arrivals


def test_scan_takes_pdf_in_any_case(spark, tmp_path):
    for name, body in (("a.pdf", b"1"), ("b.PDF", b"1"), ("c.txt", b"1")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"2")
    rows = ingest.scan_folder(spark, str(tmp_path)).collect()
    assert {r["name"] for r in rows} == {"a.pdf", "b.PDF"} and len({r["sha256"] for r in rows}) == 1


def test_scan_folder_large_files(spark, tmp_path):
    # more than one value of a row can hold; its blocks are not on the disk
    large = tmp_path / "a b%20ñ.pdf"
    with open(large, "wb") as out:
        out.write(b"start")
        out.truncate((1 << 31) + 5)
        out.seek(0, os.SEEK_END)
        out.write(b"end")
    (tmp_path / "c.pdf").write_bytes(b"small")
    with open(large, "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    rows = {r["name"]: (r["size"], r["sha256"]) for r in ingest.scan_folder(spark, str(tmp_path)).select("name", "size", "sha256").collect()}
    assert rows == {"a b%20ñ.pdf": ((1 << 31) + 8, digest), "c.pdf": (5, hashlib.sha256(b"small").hexdigest())}


def test_scan_folder_parts_give_the_same(spark, tmp_path, monkeypatch):
    for n in (1, 7, 8, 9, 100):
        (tmp_path / f"f{n}.pdf").write_bytes(bytes(i % 251 for i in range(n)))
    whole = sorted(ingest.scan_folder(spark, str(tmp_path)).collect())
    monkeypatch.setattr(ingest, "WHOLE_BYTES", 8)
    assert sorted(ingest.scan_folder(spark, str(tmp_path)).collect()) == whole
    # a store that the workers cannot open is read by Spark alone
    monkeypatch.setattr(ingest, "opens", lambda path: F.lit(False))
    assert sorted(ingest.scan_folder(spark, str(tmp_path)).collect()) == whole and len(whole) == 5


@pytest.mark.parametrize("raw, product", [
    ('```json\n{"product_id": 4, "confidence": 0.9}\n```', 4), ('Sure: {"product_id": 5} ok', 5), ("no json {", None), ('{"product_id": 6}', 6), (None, None),
])
def test_model_answers(spark, raw, product):
    row = ingest.parse_answers(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["product_id"] == product and row["unreadable"] is (product is None)


def test_admission_reasons(spark):
    rows = [("r1", "a.pdf", 10), ("r1", "a.txt", 10), ("r1", "B.PDF", 16 * 1024 * 1024)] + [("r2", f"{i}.pdf", 1) for i in range(51)]
    got = ingest.admit(spark.createDataFrame(rows, "request string, name string, size bigint"), "request")
    by = {(r["request"], r["reject_reason"]) for r in got.collect()}
    assert by == {("r1", None), ("r1", "only PDF files are accepted"), ("r1", "file is larger than 15 MB"), ("r2", "more than 50 files in the request")}


def test_write_and_wide_export(spark, tmp_path):
    field = lambda n, v, meth: (n, v, meth, None)
    rows = [(1, "t", 1, 1, 1, "A", "L", "P", 4, "alta", [field("documento", "7", "regla"), field("entidad", "0", "derivado"), field("x", None, "no_encontrado")])]
    schema = ("doc_id bigint, text string, company_id bigint, line_id bigint, product_id bigint, company string, line string, product string, score_company int, "
              "confidence string, fields array<struct<field:string,value:string,method:string,rule_id:bigint>>")
    results = spark.createDataFrame(rows, schema)
    for batch in ("1", "2", "1"):
        export.write_extraction(results, str(tmp_path), batch)
    stored = lambda name, *batches: export.read_extraction(spark, str(tmp_path), name, list(batches) or None)
    assert stored("extractions").count() == 2 and stored("extractions", "2").count() == 1
    head = stored("extractions").first()
    assert (head["by_rule"], head["not_found"], head["detection_method"], head["record"]["documento"]) == (2, 1, "patrones", "7")
    assert stored("fields").count() == 6
    wide = export.export_wide(results.withColumns({"name": F.lit("f.pdf"), "error": F.lit(None).cast("string")})).first()
    assert len(wide) == 4 + 28 + 3 and wide["Entidad"] == "Persona Física" and wide["Método"] == "Regla(2)" and wide["Error"] == ""


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A failure between two tables leaves the batch as it was; names of batches may hold any letter."""
    schema = ("doc_id bigint, text string, company_id bigint, line_id bigint, product_id bigint, company string, line string, product string, score_company int, "
              "confidence string, fields array<struct<field:string,value:string,method:string,rule_id:bigint>>")
    made = lambda value: spark.createDataFrame([(1, "t", 1, 1, 1, "A", "L", "P", 4, "alta", [("x", value, "regla", 1), ("x", "late" + value, "regla", 2)])], schema)
    folder, batch = str(tmp_path), "2024/05 ñ=1"
    with pytest.raises(ValueError):
        export.read_extraction(spark, folder, "fields")
    export.write_extraction(made("old"), folder, batch)

    def seen():
        tables = {n: export.read_extraction(spark, folder, n, [batch]).collect() for n in ("results", "extractions", "fields")}
        return tables["results"][0]["fields"][0]["value"], tables["extractions"][0]["record"], [r["value"] for r in tables["fields"]]

    before = ("old", {"x": "lateold"}, ["old", "lateold"])
    assert seen() == before

    def broken(*_):
        raise RuntimeError("lost")

    for step in ("header_rows", "long_rows", "publish_extraction"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(export, step, broken)
            export.write_extraction(made("new"), folder, batch)
        assert seen() == before
    export.write_extraction(made("new"), folder, batch)
    assert seen() == ("new", {"x": "latenew"}, ["new", "latenew"])
    assert [r["batch"] for r in export.published(spark, folder).collect()] == [batch]


def test_python_extractor_errors_become_rows(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id bigint, text string")

    def extractor(body):
        if body == "bad":
            raise ValueError("broken")
        return {"f": body, "empty": ""}

    rows = {(r["doc_id"], r["field"], r["value"], r["error"]) for r in run_extractor(docs, extractor).collect()}
    assert rows == {(1, "f", "ok", None), (2, None, None, "broken")}



def test_queue_stream_skips_known_contents(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    base, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = "doc_id bigint, text string, arrived timestamp, sha256 string"
    run = lambda: arrivals.run_queue(spark.readStream.schema(schema).parquet(source), base, samples.catalogue(spark), str(tmp_path / "log")).awaitTermination()
    rows = [(1, samples.POLICY_A, at), (2, samples.POLICY_A, at + dt.timedelta(1)), (3, " ", at), (4, "nothing", at)]
    spark.createDataFrame(rows, "doc_id bigint, text string, arrived timestamp").withColumn("sha256", ingest.content_hash("text")).coalesce(1).write.parquet(source)
    run()
    more = [(5, samples.POLICY_A, at), (6, "new text", at)]
    spark.createDataFrame(more, "doc_id bigint, text string, arrived timestamp").withColumn("sha256", ingest.content_hash("text")).coalesce(1).write.mode("append").parquet(source)
    run()
    queue = {r["doc_id"]: r["state"] for r in spark.read.parquet(f"{base}/queue").collect()}
    assert queue == {1: "clasificado", 3: "error", 4: "pendiente", 6: "pendiente"}
    assert [r["doc_id"] for r in spark.read.parquet(f"{base}/to_delete").collect()] == [2]


def test_failing_rows_become_errors_and_the_stream_goes_on(spark, tmp_path):
    import datetime as dt

    base, source = str(tmp_path / "out"), str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1)
    poison = {3, 11, 12}
    rows = [(i, f"text {i}" if i not in poison else f"poison {i}", at) for i in range(40)] + [(None, "no id", at)]
    schema = "doc_id bigint, text string, arrived timestamp"
    spark.createDataFrame(rows, schema).withColumn("sha256", ingest.content_hash("text")).coalesce(2).write.parquet(source)

    def classified(batch, catalogue):
        refused = F.raise_error(F.concat(F.lit("cannot read "), "text")).cast("string")
        return arrivals.queue_rows(batch.withColumn("text", F.when(F.col("text").startswith("poison"), refused).otherwise(F.col("text"))), catalogue)

    def run():
        stream = spark.readStream.schema(schema + ", sha256 string").parquet(source)
        arrivals.run_queue(stream, base, samples.catalogue(spark), str(tmp_path / "log"), classified=classified).awaitTermination()

    run()
    spark.createDataFrame([(50, "later", at)], schema).withColumn("sha256", ingest.content_hash("text")).coalesce(1).write.mode("append").parquet(source)
    run()
    queue = spark.read.parquet(f"{base}/queue").collect()
    assert len(queue) == 42 and {r["doc_id"] for r in queue if r["state"] == "error"} == poison
    assert all(f"poison {r['doc_id']}" in r["error"] for r in queue if r["state"] == "error")


def test_an_error_of_all_rows_is_raised(spark):
    def probe(part):
        if part.count():
            raise RuntimeError("no connection")

    with pytest.raises(RuntimeError):
        arrivals.failing_rows(spark.range(40).withColumnRenamed("id", "doc_id"), probe, most=5)


def test_watched_folder_takes_each_file_once(spark, tmp_path):
    folder, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"1")

    def run():
        stream = arrivals.watch_files(spark, str(folder)).drop("content")
        stream.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()

    run()
    (folder / "b.PDF").write_bytes(b"2")
    (folder / "c.txt").write_bytes(b"3")
    os.utime(folder / "a.pdf", (time.time(), time.time()))
    run()
    assert sorted(r["name"] for r in spark.read.parquet(out).collect()) == ["a.pdf", "b.PDF"]


def test_snapshots_rewrite_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "table")
    schema = "id bigint, name string, n int"
    made = lambda rows: spark.createDataFrame(rows, schema)
    got = lambda: sorted(map(tuple, snapshots.read(spark, folder).collect()), key=str)
    files = lambda: {f for f in snapshots.read(spark, folder).inputFiles()}
    with pytest.raises(ValueError):
        snapshots.read(spark, folder)
    start = [(i, f"n{i}", None if i % 3 else i) for i in range(200)] + [(None, "none", 1)]
    snapshots.create(made(start), folder, ["id"], buckets=8, tasks=2)
    assert got() == sorted(start, key=str)
    before = files()
    change = made([(5, "changed", None), (None, "still none", 2), (1000, "new", 3)])
    touched = snapshots.merge(spark, folder, change)
    after = files()
    assert 1 <= len(touched) <= 3 and {f for f in before if not any(f"_bucket={b}/" in f for b in touched)} <= after
    state = {r[0]: r for r in start} | {5: (5, "changed", None), None: (None, "still none", 2), 1000: (1000, "new", 3)}
    assert got() == sorted(state.values(), key=str)
    assert snapshots.merge(spark, folder, change) == set() and files() == after
    assert snapshots.merge(spark, folder, made([]), made([(5, None, None), (7777, None, None)]))
    del state[5]
    assert got() == sorted(state.values(), key=str)
    assert {r["id"] for r in snapshots.read(spark, folder, change).collect()} >= {None, 1000}
    assert snapshots.unused(spark, folder) and not any(p in f for p in snapshots.unused(spark, folder) for f in files())
    snapshots.merge(spark, folder, made([]), made(list(state.values())))
    assert got() == []


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, "a") for i in range(20)], "id bigint, v string")
    snapshots.create(rows, folder, ["id"], buckets=4)
    stale = snapshots._version(spark, folder)
    snapshots.merge(spark, folder, rows.limit(1).withColumn("v", F.lit("b")))
    with monkeypatch.context() as patch, pytest.raises(Exception, match="(?i)exist"):
        patch.setattr(snapshots, "_version", lambda *_: stale)
        snapshots.merge(spark, folder, rows.withColumn("v", F.lit("c")))
    assert sorted(r["v"] for r in snapshots.read(spark, folder).collect()) == ["a"] * 19 + ["b"]


def test_upkeep_through_snapshots_twice(spark, tmp_path):
    """An upsert of labels and a confirmation, each applied twice, give one result."""
    labels = spark.createDataFrame([(1, "a", "x", "c", 1), (2, "a", "y", "c", 1)], "doc_id bigint, field string, value string, context string, created_at int")
    folder = str(tmp_path / "labels")
    snapshots.create(labels, folder, ["doc_id", "field"], buckets=4)
    changes = spark.createDataFrame([(2, "a", "z", "d", 2), (3, "b", "w", "e", 2)], labels.schema)
    for _ in range(2):
        near = snapshots.read(spark, folder, changes)
        snapshots.merge(spark, folder, upkeep.upsert_labels(near, changes))
        assert {(r["doc_id"], r["field"], r["value"]) for r in snapshots.read(spark, folder).collect()} == {(1, "a", "x"), (2, "a", "z"), (3, "b", "w")}
    columns = "doc_id bigint, name string, sha256 string, state string, confidence string, " + ", ".join(
        f"{c}_id_{k} bigint" for k in ("prop", "final") for c in ("company", "line", "product"))
    queue = spark.createDataFrame([(i, "f.pdf", "abcdef0", m.CLASSIFIED if i % 2 else m.PENDING, m.HIGH, 1, 2, 3, None, None, None) for i in range(20)], columns)
    folder = str(tmp_path / "queue")
    snapshots.create(queue, folder, ["doc_id"], buckets=8)
    none = spark.createDataFrame([], "product_id bigint, name string")
    for again in (False, True):
        state, _ = upkeep.confirm_batch(snapshots.read(spark, folder), none)
        assert (snapshots.merge(spark, folder, state) == set()) is again
    got = {r["doc_id"]: (r["state"], r["product_id_final"]) for r in snapshots.read(spark, folder).collect()}
    assert got == {i: (m.SENT, 3) if i % 2 else (m.PENDING, None) for i in range(20)}


def test_watched_extractor(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "hang"), (4, "crash"), (5, "ok"), (6, None)], "doc_id bigint, text string").coalesce(1)

    def extractor(body):
        if body == "hang":
            time.sleep(60)
        if body == "crash":
            os._exit(3)
        if body == "bad":
            raise ValueError("broken")
        return {"f": body}

    rows = {r["doc_id"]: (r["value"], r["error"]) for r in run_extractor(docs, extractor, seconds=1).collect()}
    assert rows == {1: ("ok", None), 2: (None, "broken"), 3: (None, "no answer within 1 seconds"), 4: (None, "the extractor ended without an answer"), 5: ("ok", None)}


def test_pages_by_cursor(spark, tmp_path):
    """Pages of several appended batches with many ties equal slices of the whole order; a page reads a part of the files."""
    import datetime as dt
    import random

    rng = random.Random(2)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    batches = [[(b * 1000 + i, at(b * 20 + rng.randint(0, 25))) for i in range(120)] for b in range(4)]
    folder = str(tmp_path / "history")
    with pytest.raises(ValueError):
        history.history_total(spark, folder)
    for rows in batches:
        history.append_history(spark.createDataFrame(rows, "id bigint, created_at timestamp"), folder, files=6)
    whole = sorted((r for b in batches for r in b), key=lambda r: (r[1], r[0]), reverse=True)
    assert history.history_total(spark, folder) == len(whole)
    every = spark.read.parquet(f"{folder}/index").count()
    cursor, seen = None, []
    while True:
        assert len(history.page_files(spark, folder, 70, cursor)) < every
        page = [tuple(r) for r in history.history_after(spark, folder, 70, cursor).select("id", "created_at").collect()]
        if not page:
            break
        seen += page
        cursor = page[-1][1], page[-1][0]
    assert seen == whole
    with pytest.raises(Exception, match="no time"):
        history.append_history(spark.createDataFrame([(1, None)], "id bigint, created_at timestamp"), folder)
    assert history.history_total(spark, folder) == len(whole)
