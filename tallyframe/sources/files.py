"""Ledger files as DataFrames.

A folder of thousands of files is one job per step, never a loop per file:

* ``file_catalog`` — name, size, status, encoding, delimiter, header and column
  names of every file, from one grouped aggregate over all lines of the files
  (``_metadata.file_path`` is the key) and the first lines of each; kept by
  (path, size, modification time) where asked, so that unchanged files are not read;
* ``read_ledgers`` — the files read by their own layout (one read per distinct
  encoding, delimiter, header and ordered names), every column a string,
  ``source_file`` as the key;
* ``record_issues`` — per file what the reader mends: short and long rows, odd quotes;
* ``preview_files`` — the first 100 records per file; the rest of a file is not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import qcol
from tallyframe.session import apply_settings, ensure_checkpoint_dir, staged_table

# Fixed values that must equal the reference.
SUPPORTED_EXTENSIONS = (".csv", ".xlsx", ".xls")
CSV_DELIMITERS = (",", ";", "\t", "|")
PREVIEW_ROW_LIMIT = 100
DELIMITER_SAMPLE_LINES = 20
HEADER_HINTS = ("date", "time", "amount", "sum", "total", "category", "type", "status", "email", "phone",
                "name", "id", "created", "updated", "дата", "время", "сумма", "итого", "категория", "тип",
                "статус", "почта", "телефон", "имя", "номер")
BOOLEAN_VALUES = ("true", "false", "yes", "no", "да", "нет", "истина", "ложь")
UTF8 = "utf-8"
CP1251 = "cp1251"
# Spark charset name for cp1251 (needs spark.sql.legacy.javaCharsets in 4.x).
SPARK_CHARSETS = {UTF8: "UTF-8", CP1251: "windows-1251"}
#: Bytes of a file's start that are looked at for its first lines, at most.
HEAD_BYTES = 1 << 20
#: Lines of it, at most: as many bytes with their line ends, were they empty.
HEAD_LINES = HEAD_BYTES
#: An empty file as the file index writes it.
EMPTY_FILE = re.compile(r"path=(.*?); isDirectory=false; length=0; .*?modification_time=(\d+)")
#: Stands between the cells of a parsed header.
CELL_END = "\u001e"


def format_file_size(size: Column) -> Column:
    """Binary units: bytes as an integer, then KB/MB/GB with one decimal."""
    s = size.cast("double")
    one = lambda div, unit: F.concat(F.format_string("%.1f", s / div), F.lit(" " + unit))
    return (F.when(s < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
            .when(s < 1024 ** 2, one(1024.0, "KB")).when(s < 1024 ** 3, one(1024.0 ** 2, "MB"))
            .otherwise(one(1024.0 ** 3, "GB")))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, name, extension, size, modified`` of every file below ``paths``, empty
    ones included, from Spark's own (parallel) file index; no content is read. Hidden
    files (``_``/``.`` prefixes) are skipped like Spark's readers skip them.
    """
    found = _reader(spark, "binaryFile").load(_as_list(paths))
    listed = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                          F.col("_metadata.file_modification_time").alias("modified"))
    # scans leave empty files out, so these come from the index itself, in one call
    index = found._jdf.queryExecution().analyzed().relation().location().allFiles().mkString("\n")
    empty = [(m[1], 0, datetime.fromtimestamp(int(m[2]) / 1000, timezone.utc)) for m in EMPTY_FILE.finditer(index)]
    if empty:
        listed = listed.union(spark.createDataFrame(empty, "path string, size long, modified timestamp"))
    return listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                         _extension(F.col("path")).alias("extension"), "size", "modified")


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _reader(spark: SparkSession, fmt: str):
    """A reader of all files below its paths; a file that cannot be read, or is gone, has no rows."""
    return (spark.read.format(fmt).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
            .option("ignoreMissingFiles", "true"))


def _normalize_header_cell(c: Column) -> Column:
    t = F.translate(F.lower(c), "ё", "е")
    t = F.regexp_replace(t, r"[_\-/\\|:;.,()\[\]{}]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def headers_look_like_data(cells: Column) -> Column:
    """First-row test: no header hint word, and at least max(1, n // 2) of the
    non-empty cells look like data (boolean word, e-mail/url, date, number)."""
    non_empty = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    normed = F.transform(non_empty, _normalize_header_cell)
    hint_re = "(^| )(" + "|".join(HEADER_HINTS) + ")( |$)"
    has_hint = F.exists(normed, lambda v: v.rlike(hint_re))

    def data_like(v: Column) -> Column:
        return ((v != "") & (v.isin(*BOOLEAN_VALUES) | (F.instr(v, "@") > 0)
                             | v.rlike(r"^(http |https |www )") | v.rlike(r"^\d{4}\s\d{1,2}\s\d{1,2}")
                             | v.rlike(r"^\d{1,2}\s\d{1,2}\s\d{2,4}") | v.rlike(r"^[-+()]?[\d\s,.]+$")))
    n = F.size(non_empty)
    hits = F.size(F.filter(normed, data_like))
    return (n > 0) & ~has_hint & (hits >= F.greatest(F.lit(1), F.floor(n / 2)))


def header_names(cells: Column, has_header: Column) -> Column:
    """Column names of a file from its first record: trimmed header cells, blank ones
    ``Column i``; ``Column 1..N`` without a header. A name that occurs before gets the
    number of its occurrence (``Total``, ``Total 2``)."""
    named = F.transform(cells, lambda c, i: F.when(
        has_header & (_trimmed(c) != ""), _trimmed(c)).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))))

    def numbered(name: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda other: other == name))
        return F.when(nth > 1, F.concat(name, F.lit(" "), nth.cast("string"))).otherwise(name)

    # numbering compares names with names, so it is left to files that repeat one
    return F.when(F.size(F.array_distinct(named)) == F.size(named), named).otherwise(F.transform(named, numbered))


def _trimmed(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)^[\s\ufeff]+|\s+$", ""), F.lit(""))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _cells(parts: Column, delimiter: Column) -> Column:
    """Cells of a record from its text split at the quotes, without backtracking.

    The parts at odd places lie between two quotes. They are quoted text, in which
    delimiters do not count, if the first of the two opens a cell (or doubles a quote);
    other quotes, and a last one that nothing closes, belong to the text."""
    last = F.size(parts) - 1
    cut = lambda p: F.replace(p, delimiter, F.lit(CELL_END))

    def opens(i: Column) -> Column:
        before = F.get(parts, i - 1)
        return (before == "") | F.endswith(before, delimiter)

    def text(p: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return (F.when(odd & (i == last), F.concat(F.lit('"'), cut(p)))
                .when(odd & opens(i), p)
                .when(odd, F.concat(F.lit('"'), cut(p), F.lit('"')))
                .when((p == "") & (i > 0) & (i < last), F.lit('"'))
                .otherwise(cut(p)))

    return F.split(F.array_join(F.transform(parts, text), ""), CELL_END, -1)


def _one_file_a_task(spark: SparkSession) -> SparkSession:
    """A session of the same application whose scans give every file a task of its own, so
    that a task can stop behind the first lines of a large file."""
    sub = spark.newSession()
    apply_settings(sub)
    for conf in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        sub.conf.set(conf, str(1 << 50))
    sub.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    return sub


def _starts(session: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value binary, whole) of the lines of the pieces at the start of CSV files."""
    lines = _reader(session, "text").option("pathGlobFilter", "*.[cC][sS][vV]").load(paths)
    return lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"),
        (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"))


def _first_of_each_task(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every task. A Python function that ends early leaves it to chance
    whether its task still reads all of the file: what its worker drains is written on."""
    # a limit is the first rows of all tasks' first rows: the inner step is enough
    plan = df.limit(n)._jdf.logicalPlan().child()
    return DataFrame(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), plan), df.sparkSession)


HEAD = ("path string, head array<binary>, utf8 boolean, quotes long, multi_line boolean, lines long, records long, "
        "whole boolean")


def _first_lines(raw: DataFrame) -> DataFrame:
    """``HEAD`` rows, one per file, from (path, value binary[, whole: the task's piece is all of the
    file]) of the pieces at the start of files; a session that gives each file its task has no other. The
    first lines that are not blank, and what can be said of the lines seen. Reading stops once
    the lines and the preview's records are there."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, head, utf8, quotes, odd, lines, records, size = None, [], True, 0, False, 0, 0, 0
        whole, seen = True, 0
        for batch in batches:
            seen += batch.num_rows
            if batch.num_rows:
                path, whole = batch.column(0)[0].as_py(), batch.column(2)[0].as_py()
            for line in batch.column(1).to_pylist():
                size += len(line)
                if utf8:
                    try:
                        line.decode("utf-8")
                    except UnicodeDecodeError:
                        utf8 = False
                own = line.count(b'"')
                quotes, odd = quotes + own, odd or own % 2 == 1
                if line.strip(b" "):
                    lines += 1
                    records += quotes % 2 == 0
                    if len(head) < DELIMITER_SAMPLE_LINES:
                        head.append(line)
            # small files are read to their end, which keeps the worker process
            if size > HEAD_BYTES or (size > HEAD_BYTES // 8 and len(head) == DELIMITER_SAMPLE_LINES
                                     and records > PREVIEW_ROW_LIMIT + 1):
                whole = False
                break
        whole = whole and seen < HEAD_LINES
        if path is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([head], pa.list_(pa.binary())), *(pa.array([x]) for x in (utf8, quotes, odd, lines, records, whole))],
                ["path", "head", "utf8", "quotes", "multi_line", "lines", "records", "whole"])

    if "whole" not in raw.columns:
        raw = raw.withColumn("whole", F.lit(True))
    return _first_of_each_task(raw, HEAD_LINES).mapInArrow(look, HEAD)


CATALOG_COLUMNS = ("path", "name", "extension", "size", "modified", "status", "size_text", "encoding", "delimiter",
                   "has_header", "column_count", "column_names", "multi_line", "odd_quotes", "records", "row_count_text")
_TYPES = {"has_header": "boolean", "multi_line": "boolean", "odd_quotes": "boolean", "column_count": "int",
          "column_names": "array<string>", "records": "long"}
KEPT_BY = ("path", "size", "modified")


def file_catalog(spark: SparkSession, paths: str | Sequence[str], kept: str | None = None,
                 heads_only: bool = False) -> DataFrame:
    """One row per file (``CATALOG_COLUMNS``); status ok / unsupported / empty / error.

    Every CSV file is judged whole, in one distributed pass over its lines: UTF-8 if
    every line is valid UTF-8, else cp1251; ``odd_quotes`` if the file's quotes are odd
    in number, so that one is never closed; ``multi_line`` if they are even and some
    line has an odd number, so that a quoted field goes over several lines. The
    delimiter comes from the first 20 lines that are not blank, header and names from
    the first of them, which are read by tasks that stop there. A file that cannot be
    read has status ``error`` and leaves the others alone. ``records`` counts them.

    ``heads_only`` judges on at most ``HEAD_BYTES`` of each file: encoding and quotes of
    these, ``records`` null where the file goes on.

    ``kept`` names a folder in which judged rows are kept by (path, size, modification
    time): only new and changed files are read. The result is written to the shared
    folder: a row per file, read again by each later step.
    """
    ensure_checkpoint_dir(spark)
    files = list_files(spark, paths)
    status = (F.when(~F.col("extension").isin(*SUPPORTED_EXTENSIONS), F.lit("unsupported"))
              .when(F.col("size") == 0, F.lit("empty")).otherwise(F.lit("ok")))
    files = staged_table(files.withColumn("status", status).withColumn("size_text", format_file_size(F.col("size"))),
                         "catalog")
    if kept is None:
        return staged_table(_judged(spark, files, _as_list(paths), heads_only), "catalog")
    known = _kept(spark, kept)
    fresh = files
    if known is not None:
        fresh = staged_table(files.join(known, list(KEPT_BY), "left_anti"), "catalog")
    if not fresh.isEmpty():
        new = [r.path for r in fresh.where((F.col("extension") == ".csv") & (F.col("status") == "ok")).select("path").collect()]
        _judged(spark, fresh, new, heads_only).write.mode("append").parquet(kept)
        known = _kept(spark, kept)
    if known is None:
        return _judged(spark, files, [], heads_only)
    return staged_table(files.select(*KEPT_BY).join(known, list(KEPT_BY)).select(*CATALOG_COLUMNS), "catalog")


def _kept(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows kept in ``folder``, each file state once; null if there are none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(folder).dropDuplicates(list(KEPT_BY))


def _judged(spark: SparkSession, files: DataFrame, paths: list[str], heads_only: bool) -> DataFrame:
    """``CATALOG_COLUMNS`` of ``files``, whose CSV files lie below ``paths``."""
    if not paths:
        return files.select(*[F.col(c) if c in files.columns else F.lit(None).cast(_TYPES.get(c, "string")).alias(c)
                              for c in CATALOG_COLUMNS])

    def raw(session: SparkSession) -> DataFrame:
        lines = _reader(session, "text").option("pathGlobFilter", "*.[cC][sS][vV]").load(paths)
        return lines.select(F.col("_metadata.file_path").alias("path"), "value")

    heads = staged_table(_first_lines(_starts(_one_file_a_task(spark), paths)), "heads", spark)
    if heads_only:
        facts = heads.withColumn("records", F.when(F.col("whole"), F.col("records"))).withColumn(
            "lines", F.when(F.col("whole"), F.col("lines")))
    else:
        whole = raw(spark).groupBy("path").agg(
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.sum(_quotes(F.col("value"))).alias("quotes"),
            F.bool_or(_quotes(F.col("value")) % 2 == 1).alias("multi_line"),
            F.count_if(F.trim("value") != "").alias("lines"))
        # what a file's first task saw of all its lines is the count of its records
        facts = whole.join(heads.select("path", "head", F.when(F.col("whole"), F.col("records")).alias("records")), "path", "left")
    facts = facts.withColumn("encoding", F.when(F.col("utf8"), UTF8).otherwise(CP1251))
    facts = facts.withColumn("odd_quotes", F.col("quotes") % 2 == 1)
    facts = facts.withColumn("multi_line", F.col("multi_line") & ~F.col("odd_quotes"))
    decoded = F.transform("head", lambda h: F.when(F.col("utf8"), h.cast("string")).otherwise(
        F.decode(h, SPARK_CHARSETS[CP1251])))
    facts = facts.withColumn("head", F.coalesce(decoded, F.array().cast("array<string>")))
    joined = F.array_join("head", "\n")
    counts = [F.length(joined) - F.length(F.replace(joined, F.lit(d), F.lit(""))) for d in CSV_DELIMITERS]
    choice = F.lit(CSV_DELIMITERS[0])
    for d, n in reversed(list(zip(CSV_DELIMITERS, counts))):
        choice = F.when(n == F.greatest(*counts), F.lit(d)).otherwise(choice)
    facts = facts.withColumn("delimiter", F.when(F.greatest(*counts) > 0, choice).otherwise(F.lit(CSV_DELIMITERS[0])))
    first = F.regexp_replace(F.coalesce(F.get("head", F.lit(0)), F.lit("")), "^\ufeff", "")
    facts = facts.withColumn("parts", F.split(F.translate(first, CELL_END, " "), '"', -1)).drop("head")
    facts = staged_table(facts, "facts")
    facts = facts.withColumn("cells", F.when((F.size("parts") == 1) & (F.trim(F.get("parts", F.lit(0))) == ""),
                                             F.array().cast("array<string>"))
                             .otherwise(_cells(F.col("parts"), F.col("delimiter"))))
    facts = facts.withColumn("has_header", ~headers_look_like_data(F.col("cells")))
    facts = facts.withColumn("column_names", header_names(F.col("cells"), F.col("has_header"))).withColumn(
        "column_count", F.size("cells"))
    # lines are records, but for files with quoted line ends: these are counted by the tasks
    # that saw all of a file, and larger ones are read
    facts = facts.withColumn("records", F.when(F.col("multi_line"), F.col("records")).otherwise(F.col("lines"))
                             - F.col("has_header").cast("int"))
    facts = facts.select("path", "encoding", "delimiter", "has_header", "column_count", "column_names", "multi_line",
                         "odd_quotes", "records")
    large = facts.where(F.col("multi_line") & F.col("records").isNull())
    if not heads_only and not large.isEmpty():
        read = _read_groups(spark, large).groupBy("source_file").agg(F.count("*").alias("n"))
        facts = facts.join(read, F.col("path") == F.col("source_file"), "left").withColumn(
            "records", F.coalesce("n", "records")).drop("n", "source_file")
    more = F.col("records").isNull() if heads_only else F.lit(False)
    text = F.when(more | (F.col("records") > PREVIEW_ROW_LIMIT), F.lit(f"{PREVIEW_ROW_LIMIT}+ (fast preview)")) \
        .otherwise(F.col("records").cast("string"))
    csv = (F.col("extension") == ".csv") & (F.col("status") == "ok")
    out = files.join(facts, "path", "left").withColumn("row_count_text", F.when(F.col("encoding").isNotNull(), text))
    # nothing could be read of a file that is not empty
    return out.withColumn("status", F.when(csv & F.col("encoding").isNull(), F.lit("error")).otherwise(F.col("status"))) \
        .select(*CATALOG_COLUMNS)


def generic_names(n: int) -> list[str]:
    return [f"Column {i + 1}" for i in range(n)]


def _csv_reader(spark: SparkSession, encoding: str, delimiter: str, header: bool, multi_line: bool):
    return (spark.read.option("header", str(header).lower()).option("sep", delimiter)
            .option("encoding", SPARK_CHARSETS.get(encoding, encoding)).option("mode", "PERMISSIVE")
            .option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower())
            .option("maxColumns", str(1 << 20)).option("enforceSchema", "true"))


def read_csv(spark: SparkSession, paths: Sequence[str], encoding: str = UTF8, delimiter: str = ",",
             header: bool = True, columns: Sequence[str] | None = None, names: Sequence[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV ledger files of one layout, every column a string, ``source_file`` key.

    ``names`` are the columns in file order (by default those of the first file's
    catalog row). Quotes inside quoted fields are doubled; ``multi_line`` reads quoted
    fields over several lines. Short rows are null-padded, extra fields dropped, no
    schema inference. ``columns`` selects (and orders) the columns read.
    """
    if columns is not None and not list(columns):
        raise ValueError("Select at least one column to load.")
    if names is None:
        names = file_catalog(spark, [paths[0]]).first().column_names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = _csv_reader(spark, encoding, delimiter, header, multi_line).schema(schema).csv(list(paths))
    src = F.col("_metadata.file_path").alias("source_file")
    if columns:
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"Columns not found: {missing}")
    return df.select(src, *[qcol(c) for c in dict.fromkeys(columns or names)])


LAYOUT = ("encoding", "delimiter", "has_header", "column_names", "multi_line")


def layouts(catalog: DataFrame) -> list:
    """The distinct layouts of a catalog's readable CSV files with their paths: one row
    per (encoding, delimiter, header, ordered names, multi_line)."""
    ok = catalog.where((F.col("status") == "ok") & (F.col("extension") == ".csv") & (F.col("column_count") > 0))
    return (ok.groupBy(*LAYOUT)
            .agg(F.sort_array(F.collect_list("path")).alias("paths")).collect())


def read_layout(spark: SparkSession, layout, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``read_csv`` of files of one layout (a row with the ``LAYOUT`` fields)."""
    return read_csv(spark, paths, layout.encoding, layout.delimiter, bool(layout.has_header), columns, layout.column_names,
                    bool(layout.multi_line))


def _read_groups(spark: SparkSession, catalog: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    if "status" not in catalog.columns:
        catalog = catalog.withColumn("status", F.lit("ok")).withColumn("extension", F.lit(".csv"))
    groups = layouts(catalog)
    if not groups:
        raise ValueError("No readable CSV files.")
    if columns is not None:
        known = {n for g in groups for n in g.column_names}
        missing = [c for c in columns if c not in known]
        if missing:
            raise ValueError(f"Columns not found: {missing}")
    parts = []
    for g in groups:
        own = None if columns is None else [c for c in columns if c in g.column_names]
        if own == []:
            own = g.column_names[:1]  # rows without any of the columns still count
        part = read_layout(spark, g, g.paths, own)
        if columns is not None:
            part = part.select("source_file", *[qcol(c) if c in g.column_names else F.lit(None).cast("string").alias(c)
                                                for c in dict.fromkeys(columns)])
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_ledgers(spark: SparkSession, catalog: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Read every ok CSV file of a catalog by its own layout, one read per distinct
    layout, and union the columns by name (null where a file lacks one)."""
    if columns is not None and not list(columns):
        raise ValueError("Select at least one column to load.")
    return _read_groups(spark, catalog, columns)


def record_issues(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """What the reader mended, per readable CSV file: ``source_file, records, short``
    (rows null-padded), ``long`` (rows whose extra fields were dropped), ``odd_quotes``
    (a quote is never closed: the file is read line by line, so that it takes no other
    line with it) and ``lines_in_quotes`` (line ends inside quoted fields)."""
    mended = "__mended"
    parts = []
    for g in layouts(catalog):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*g.column_names, mended]])
        rows = (_csv_reader(spark, g.encoding, g.delimiter, bool(g.has_header), bool(g.multi_line))
                .schema(schema).option("columnNameOfCorruptRecord", mended).csv(g.paths))
        # all columns are asked for, so that the reader parses them; a mended record is told by its text
        n = F.size(_cells(F.split(F.translate(mended, CELL_END, " "), '"', -1), F.lit(g.delimiter)))
        parts.append(rows.select(F.col("_metadata.file_path").alias("source_file"), F.array(*map(qcol, g.column_names)).alias("cells"),
                                 F.when(F.col(mended).isNotNull(), n - len(g.column_names)).alias("more"),
                                 sum((F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) for c in
                                      (F.coalesce(qcol(c), F.lit("")) for c in g.column_names)), F.lit(0)).alias("ends")))
    if not parts:
        raise ValueError("No readable CSV files.")
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    counted = rows.groupBy("source_file").agg(
        F.count("cells").alias("records"), F.count_if(F.col("more") < 0).alias("short"),
        F.count_if(F.col("more") > 0).alias("long"), F.sum("ends").alias("lines_in_quotes"))
    facts = catalog.select(F.col("path").alias("source_file"), "odd_quotes")
    return counted.join(facts, "source_file").select("source_file", "records", "short", "long", "odd_quotes", "lines_in_quotes")


def preview_files(spark: SparkSession, catalog: DataFrame, limit: int = PREVIEW_ROW_LIMIT) -> DataFrame:
    """The first ``limit`` records of every ok CSV file, by the same reader as the
    analysis, with the catalog's names and row-count status:
    ``source_file, row_no, column_names, cells, row_count_text``. A file's task stops
    behind its last previewed record."""
    sub = _one_file_a_task(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.slice(0, limit - seen)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), pa.array(range(seen + 1, seen + 1 + own.num_rows), pa.int64()), own.column(1), own.column(2)],
                ["source_file", "row_no", "column_names", "cells"])
            seen += own.num_rows
            if seen >= limit:
                return

    parts = []
    for g in layouts(catalog):
        part = read_layout(sub, g, g.paths)
        parts.append(part.select("source_file", F.array(*[F.lit(n) for n in g.column_names]).alias("column_names"),
                                 F.array(*[qcol(n) for n in g.column_names]).alias("cells"))
                     .mapInArrow(first, "source_file string, row_no long, column_names array<string>, cells array<string>"))
    if not parts:
        raise ValueError("No readable CSV files.")
    rows = staged_table(reduce(lambda a, b: a.unionByName(b), parts), "preview", spark)
    texts = catalog.select(F.col("path").alias("source_file"), "row_count_text")
    return rows.join(texts, "source_file").select("source_file", "row_no", "column_names", "cells", "row_count_text")


def write_report(report: DataFrame, path: str, keys: Sequence[str] = (), fmt: str = "csv") -> None:
    """Write a long report table, partitioned by keys; CSV uses ``;``."""
    w = report.write.mode("overwrite")
    if keys:
        w = w.partitionBy(*keys)
    if fmt == "csv":
        w.option("sep", ";").option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
