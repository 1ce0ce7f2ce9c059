"""File sources and sinks.

Readers return lazy DataFrames; writers are Spark jobs that write in parallel from
the executors (no driver-side concatenation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.functions.text import LABEL_MARK, strip_line_quotes
from chorus.operators.ranking import position_within

# ---------------------------------------------------------------------------
# Labelled-line codes and their words
#   z_amb -> ambiguous, z_minus_m -> negative, z_plus_m -> positive, z_zero -> neutral
# ---------------------------------------------------------------------------
LABEL_CODES = {"z_amb": "ambiguous", "z_minus_m": "negative", "z_plus_m": "positive", "z_zero": "neutral"}


# --- IO1 -------------------------------------------------------------------
def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob (or below a directory), listed through the Hadoop file
    system like any Spark source listing - no data is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    stats = fs.globStatus(path) or []
    out: list[str] = []
    for st in stats:
        if st.isDirectory():
            it = fs.listFiles(st.getPath(), True)
            while it.hasNext():
                out.append(it.next().getPath().toString())
        else:
            out.append(st.getPath().toString())
    return sorted(f for f in out if not f.rsplit("/", 1)[-1].startswith(("_", ".")))


def _csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line, read by one distributed job: the
    first line of a file is the one at block offset 0."""
    import csv

    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )
    heads = lines.where("b = 0").groupBy("f").agg(F.min_by("value", "i").alias("head"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in heads.orderBy("f").collect():  # one line per file
        groups.setdefault(tuple(next(csv.reader([r["head"].lstrip("﻿")]), [])), []).append(r["f"])
    return groups


def read_csv_dir(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All CSV files of a directory (or glob), combined by column name.

    With a schema every file is read in one scan.  Otherwise files are grouped by
    their header (one job finds the first line of every file) and each group is one
    scan; the groups are unioned by name, missing columns becoming null.
    """
    opts = dict(header=True, multiLine=True, escape='"', quote='"')
    if schema is not None:
        return spark.read.options(**opts).schema(schema).csv(path)
    frames = [spark.read.options(**opts).csv(fs) for fs in _csv_headers(spark, path).values()]
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    return out


def read_csv_indexed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV whose first column is a written row index: the index is dropped."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.drop(df.columns[0])


# --- IO2 -------------------------------------------------------------------
def read_accounts(
    spark: SparkSession,
    path: str,
    link_column: str = "link",
    url_prefix: str = "https://twitter.com/",
    n_columns: int = 5,
) -> DataFrame:
    """Account list: skip the first data line of every file, keep the first
    ``n_columns`` columns, drop rows with any null, derive ``username`` by stripping the
    URL prefix, add a null ``tweets_count``."""
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    cols = raw.columns[:n_columns]
    # The first data line of each file is a sub-header: within a file the rows keep
    # file order, so it holds the file's smallest row id (ids come from the file
    # split plan, which is the same for both uses below).
    indexed = raw.select(*cols, F.col("_metadata.file_path").alias("_f")).withColumn("_row", F.monotonically_increasing_id())
    first = indexed.groupBy("_f").agg(F.min("_row").alias("_row"))  # one row per file
    body = indexed.join(first, ["_f", "_row"], "left_anti").drop("_f", "_row")
    body = body.dropna(how="any")
    return body.withColumn("username", F.replace(F.col(link_column), F.lit(url_prefix), F.lit(""))).withColumn(
        "tweets_count", F.lit(None).cast("long")
    )


# --- IO4 -------------------------------------------------------------------
def parse_labelled_lines(lines: DataFrame, col: str = "value", codes: dict[str, str] | None = None) -> DataFrame:
    """``<text>__label__<code>`` -> (text, label).  A line without the marker raises."""
    codes = codes or LABEL_CODES
    v = F.col(col)
    at = F.instr(v, LABEL_MARK)
    code = F.substring(v, at + len(LABEL_MARK), 1 << 30)
    mapping = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return lines.select(
        F.when(at > 0, F.substring(v, 1, at - 1))
        .otherwise(F.raise_error(F.concat(F.lit("no label in line: "), v)))
        .alias("text"),
        F.coalesce(F.element_at(mapping, code), code).alias("label"),
    )


def read_labelled_lines(spark: SparkSession, path: str, codes: dict[str, str] | None = None) -> DataFrame:
    return parse_labelled_lines(spark.read.text(path), "value", codes)


# --- IO5 -------------------------------------------------------------------
def read_jsonc_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of strings with ``//`` comments -> one row per entry (``word``), file order kept
    in ``pos``.  ``//`` inside a string is text; a file that is no list of strings raises."""
    doc = spark.read.text(path, wholetext=True)
    # a whole string is matched first and put back, so only comments outside are dropped
    body = F.regexp_replace(F.col("value"), r'("(?:[^"\\\\]|\\\\.)*+")|//[^\n]*', "$1")
    words = F.from_json(body, "array<string>")
    words = F.when(words.isNull(), F.raise_error(F.concat(F.lit("not a JSON list of strings: "), F.left(body, F.lit(100))))).otherwise(words)
    return doc.select(F.posexplode(words).alias("pos", "word"))


# --- IO6 -------------------------------------------------------------------
def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object -> ordered (pos, k, v) entries; file order is meaningful."""
    doc = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json(F.col("value"), "map<string,string>"))
    return doc.select(F.posexplode(entries).alias("pos", "e")).select("pos", F.col("e.key").alias("k"), F.col("e.value").alias("v"))


# --- IO10 / IO11 / IO12 ----------------------------------------------------
def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_text_lines(df: DataFrame, line: F.Column | str, path: str, mode: str = "errorifexists") -> None:
    """One formatted row per line, no header and no quoting."""
    col = F.col(line) if isinstance(line, str) else line
    df.select(col.alias("value")).write.mode(mode).text(path)


def read_text_lines(spark: SparkSession, path: str, strip_quotes: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(strip_line_quotes("value").alias("value")) if strip_quotes else lines


# --- IO13 ------------------------------------------------------------------
def write_table(df: DataFrame, name: str, path: str | None = None, index_col: str | None = "index", order_by: list[str] | None = None) -> None:
    """Relational sink that fails when the table exists; writes a dense index 0..n-1 in the
    order of ``order_by`` (a total order; by default all columns)."""
    out = position_within(df, [], list(order_by or df.columns), out=index_col) if index_col else df
    w = out.write.mode("errorifexists").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


# --- IO14 ------------------------------------------------------------------
def write_named_texts(df: DataFrame, path: str, key: str = "username", name_col: str = "file_name", text_col: str = "text") -> None:
    """Per-key text output, the file name kept as a column: ``partitionBy(key)`` writes one
    directory per key instead of one file per row."""
    df.select(key, name_col, text_col).write.mode("errorifexists").partitionBy(key).parquet(path)


# --- IO15 ------------------------------------------------------------------
def append_missing_keys(todo: DataFrame, done_path: str, key: str, spark: SparkSession) -> DataFrame:
    """Rows of ``todo`` whose key has no stored partial yet (left anti join)."""
    if not list_files(spark, done_path):  # nothing stored yet
        return todo
    return todo.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti")


def write_partials(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("append").partitionBy(key).parquet(path)


# --- IO16 ------------------------------------------------------------------
def write_nested_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)
