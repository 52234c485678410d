"""Getting documents in: folders, hashes, page texts, admission, model answers."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.binding import regexp_extract
from fieldloom import model as m
from fieldloom.functions.text import strip
from fieldloom.operators.bounds import rows_within

PDF_GLOB = "*.[pP][dD][fF]"
WHOLE_BYTES = 64 << 20  # a larger file is hashed part by part, as Spark's reader makes one value of a file, of 2 GB at most
PART_BYTES = 8 << 20


def scan_folder(spark: SparkSession, folder: str, glob: str = PDF_GLOB) -> DataFrame:
    """Files of one folder: path, name, mtime, size, sha256, content.

    Beyond ``WHOLE_BYTES`` the hash is made from the file itself, in parts, where the
    workers can open it; in a store that only Spark reads it is made from the content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    large = files.filter(F.col("length") > WHOLE_BYTES)
    # names and sizes are looked at here, no content is read
    if not large.select("path").head(1) or not large.agg(F.min(opens("path"))).first()[0]:
        return describe_files(files)
    return describe_files(files.filter(F.col("length") <= WHOLE_BYTES)).unionByName(describe_files(large, file_hash("path")))


def describe_files(files: DataFrame, sha256: Column | None = None) -> DataFrame:
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"), (content_hash("content") if sha256 is None else sha256).alias("sha256"), "content",
    )


def _open(path: str):
    """The file of a path as Spark names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_file(inner)


@F.pandas_udf(T.BooleanType())
def opens(paths: pd.Series) -> pd.Series:
    """Can a worker open each file?"""

    def opened(path: str) -> bool:
        try:
            _open(path).close()
        except (OSError, ValueError, NotImplementedError, ImportError):  # Arrow's own errors are among these
            return False
        return True

    return paths.map(opened).astype(bool)


@F.pandas_udf(T.StringType())
def file_hash(paths: pd.Series) -> pd.Series:
    """SHA-256 of each file, hex, with ``PART_BYTES`` of it in memory."""

    def hashed(path: str) -> str:
        digest = hashlib.sha256()
        with _open(path) as file:
            while part := file.read(PART_BYTES):
                digest.update(part)
        return digest.hexdigest()

    return paths.map(hashed)


def content_hash(content: str | Column) -> Column:
    """SHA-256 of bytes or text, hex."""
    return F.sha2(content, 256)


def with_file_present(documents: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Flag documents whose file is in a fresh listing."""
    seen = listing.select(F.col("path").alias(path)).distinct().withColumn("_seen", F.lit(True))
    joined = documents.join(seen, path, "left")
    return joined.select(*documents.columns, F.coalesce("_seen", F.lit(False)).alias("file_present"))


def assemble_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", keep_empty: bool = False) -> DataFrame:
    """Text and number of pages of each document.

    Empty pages are dropped, or kept with the whole text trimmed.  The pages of a
    document meet in one row because its text is one value.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    grouped = pages.groupBy(doc).agg(held.alias("_p"), F.count(F.lit(1)).alias("pages"))
    texts = F.transform("_p", lambda x: x["t"])
    joined = strip(F.array_join(texts, "\n")) if keep_empty else F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return grouped.select(doc, joined.alias("text"), "pages")


def admit(files: DataFrame, request: str | None = None, name: str = "name", size: str = "size",
          max_files: int = m.FILES_PER_REQUEST, max_mb: int = m.MAX_FILE_MB) -> DataFrame:
    """Add ``reject_reason``: request too large, not a PDF, file too large, else NULL.

    ``request``: column that tells the requests apart.  Its rows are counted with
    partial sums and only the few over-long requests are joined back.
    """
    reason = (
        F.when(~F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False)), F.lit("only PDF files are accepted"))
        .when(F.col(size) > max_mb * 1024 * 1024, F.lit(f"file is larger than {max_mb} MB"))
    )
    if request is None:
        return files.withColumn("reject_reason", reason)
    too_long = files.groupBy(request).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_files).select(request, F.lit(True).alias("_long"))
    joined = files.join(too_long, request, "left")
    return joined.select(
        *files.columns, F.when(F.col("_long"), F.lit(f"more than {max_files} files in the request")).otherwise(reason).alias("reject_reason")
    )


def accepted(admitted: DataFrame) -> DataFrame:
    return admitted.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(admitted: DataFrame) -> DataFrame:
    return admitted.filter(F.col("reject_reason").isNotNull())


def without_text(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents that cannot be extracted, with the reason."""
    return documents.filter(F.coalesce(F.length(strip(F.col(text))), F.lit(0)) == 0).withColumn("error", F.lit("no extractable text"))


# ---- model answers and requests ----------------------------------------------------

ANSWER = "struct<company_id:bigint,line_id:bigint,product_id:bigint,confidence:double,reason:string,is_new:boolean>"


def clean_json(raw: Column) -> Column:
    """Answer without its code fence."""
    text = F.regexp_replace(strip(raw), "(?i)^```(?:json)?\\s*\\n?", "")
    return strip(F.regexp_replace(text, "\\n?```\\s*$", ""))


def json_object(raw: Column) -> Column:
    """A JSON object as text: the cleaned answer, else the widest {...} block, else NULL."""
    whole = clean_json(raw)
    block = F.nullif(regexp_extract(raw, F.lit("(?s)\\{.*\\}"), F.lit(0)), F.lit(""))
    usable = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(c, F.lit("{")), c)
    return F.coalesce(usable(whole), usable(block))


def parse_answers(answers: DataFrame, raw: str = "raw", schema: str = ANSWER) -> DataFrame:
    """Parsed answer columns; an unreadable answer gives NULLs and a flag."""
    parsed = answers.withColumn("_j", json_object(F.col(raw))).withColumn("_a", F.from_json("_j", schema))
    return parsed.select(*answers.columns, F.col("_a.*"), F.col("_j").isNull().alias("unreadable"))


def catalogue_json(catalogue: DataFrame, max_entries: int = 20_000) -> str:
    """Flat list of company, line and product as JSON text (configuration)."""
    level = lambda lv: catalogue.filter((F.col("level") == lv) & F.col("active"))
    company = level(m.COMPANY).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    line = level(m.LINE).select(F.col("id").alias("line_id"), F.col("parent_id").alias("company_id"), F.col("name").alias("line"))
    product = level(m.PRODUCT).select(F.col("id").alias("product_id"), F.col("parent_id").alias("line_id"), F.col("name").alias("product"))
    flat = product.join(line, "line_id").join(company, "company_id")
    names = ["company_id", "company", "line_id", "line", "product_id", "product"]
    rows = rows_within(flat.orderBy("company_id", "line_id", "product_id").select(F.to_json(F.struct(*names)).alias("j")), max_entries)
    if rows is None:
        raise ValueError("the catalogue is too large for a request")
    return "[" + ",".join(r["j"] for r in rows) + "]"


def model_requests(docs: DataFrame, catalogue_text: str, chars: int = m.REQUEST_CHARS) -> DataFrame:
    """One request per document: catalogue and start of the text."""
    return docs.select("doc_id", F.lit(catalogue_text).alias("catalogue"), F.left("text", F.lit(chars)).alias("excerpt"))


def pattern_requests(detected: DataFrame, chars: int = m.PATTERN_REQUEST_CHARS) -> DataFrame:
    """One request for patterns per placed document: the names of its levels and the start of its text."""
    placed = detected.filter(F.col("company").isNotNull())
    return placed.select("doc_id", "company", "line", "product", F.left("text", F.lit(chars)).alias("excerpt"))


def example_requests(labels: DataFrame, keys: list[str], chars: int = m.EXAMPLE_CHARS) -> DataFrame:
    """Labelled examples of a field in one text, in document order.

    A request goes to a model, so its examples fit in one text.
    """
    line = F.concat(
        F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("value"), F.lit("\n"),
        F.left(F.coalesce("context", F.lit("")), F.lit(chars)),
    )
    held = F.array_sort(F.collect_list(F.struct("doc_id", line.alias("t"))))
    return labels.filter(F.col("value").isNotNull()).groupBy(*keys).agg(held.alias("_e")).select(
        *keys, F.size("_e").alias("n_examples"), F.array_join(F.transform("_e", lambda e: e["t"]), "\n").alias("examples")
    )


def recent_texts(extractions: DataFrame, product_id: int, n: int = 10) -> DataFrame:
    """Newest texts of one product."""
    return extractions.filter((F.col("product_id") == product_id) & F.col("successful") & F.col("text").isNotNull()).orderBy(
        F.desc("created_at"), F.desc("id")
    ).limit(n)
