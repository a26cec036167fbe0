"""Ledger files derived from the driver tables, written to the shared folder.

The source queries read real files, so these stage ``orders`` as exported
ledgers would look: several CSV dialects and encodings, and workbooks. Files
go under ``spark.checkpoint.dir`` (the cluster's shared folder).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans import views
from tallyframe.session import shared_path
from tallyframe.sources.workbook import write_xlsx

# Russian category names for the cp1251 variant (by priority).
PRIORITY_RU = {"1-URGENT": "Срочно", "2-HIGH": "Высокий", "3-MEDIUM": "Средний", "4-NOT SPECIFIED": "Не указан",
               "5-LOW": "Низкий"}
#: ``order`` sorts each file; ``keep_spaces`` writes padded header names as they are.
VARIANTS = {
    "utf8_comma": {"sep": ",", "encoding": "UTF-8", "header": True},
    "cp1251_semicolon": {"sep": ";", "encoding": "windows-1251", "header": True},
    "tab_headerless": {"sep": "\t", "encoding": "UTF-8", "header": False},
    "pipe": {"sep": "|", "encoding": "UTF-8", "header": True},
    # columns in another order, padded names, doubled quotes, line ends inside quotes
    "permuted_quotes": {"sep": ",", "encoding": "UTF-8", "header": True, "keep_spaces": True},
    # the first character that is not ASCII comes after most of the file
    "late_cp1251": {"sep": ",", "encoding": "windows-1251", "header": True, "order": ["Priority", "OrderDate"]},
}
#: Files that must not stop a folder: names of 15,000 characters, and of 50,000 quotes.
ODD = {
    "long_name": {"sep": ",", "encoding": "UTF-8", "header": True, "name": "note, " * 2500 + "x"},
    "many_quotes": {"sep": ",", "encoding": "UTF-8", "header": True, "name": '"' * 50_000},
}
ENGLISH = ("utf8_comma", "pipe", "permuted_quotes", "late_cp1251")
LEAST_FILES = 3
FILE_BYTES = 128 * 1024 * 1024
#: Rows of a staged file, about: a task writes one, and files with quoted line ends are read by one task.
FILE_ROWS = 500_000


def _table_files(spark: SparkSession, sf_dir: str, table: str) -> list[tuple[str, int, int]]:
    """Name, size and time of each file of a driver table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def stage_root(spark: SparkSession, sf_dir: str) -> str:
    """Where the files staged from this state of the tables lie: a table that is
    written anew gets another folder."""
    state = repr([_table_files(spark, sf_dir, t) for t in ("orders", "events")])
    return shared_path(spark, "staged", hashlib.sha1(state.encode()).hexdigest()[:16])


def _file_count(spark: SparkSession, sf_dir: str, table: str) -> int:
    size = sum(n for _, n, _ in _table_files(spark, sf_dir, table))
    # a table of repeated values is small in Parquet, whatever its rows
    return max(LEAST_FILES, size // FILE_BYTES + 1, -(-views.table(spark, sf_dir, table).count() // FILE_ROWS))


def _variant_frame(o: DataFrame, name: str) -> DataFrame:
    price = F.format_string("%.2f", F.col("o_totalprice"))
    if name in ODD:
        return o.select(F.col("o_orderstatus").alias(ODD[name]["name"]), price.alias("TotalPrice"))
    if name == "cp1251_semicolon":
        ru = F.create_map(*[x for k, v in PRIORITY_RU.items() for x in (F.lit(k), F.lit(v))])
        return o.select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("Дата операции"),
                        ru[F.col("o_orderpriority")].alias("Категория"),
                        F.regexp_replace(price, r"\.", ",").alias("Сумма дохода"),
                        F.col("o_orderkey").cast("string").alias("Номер заказа"))
    if name == "permuted_quotes":
        note = F.when(F.col("o_orderkey") % 3 == 0, F.lit('said "ok", then\nleft')).when(
            F.col("o_orderkey") % 3 == 1, F.lit('a "quoted" word'))
        return o.select(price.alias(" TotalPrice"), F.col("o_orderpriority").alias("Priority "), note.alias("Note"),
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("OrderDate"))
    if name == "late_cp1251":
        late = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(PRIORITY_RU["5-LOW"])).otherwise(F.col("o_orderpriority"))
        return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("OrderDate"), late.alias("Priority"),
                        price.alias("TotalPrice"))
    return o.select(F.col("o_orderkey").cast("string").alias("OrderID"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("OrderDate"),
                    F.col("o_orderpriority").alias("Priority"), price.alias("TotalPrice"),
                    F.col("o_orderstatus").alias("Status"))


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp))


def stage_csv(spark: SparkSession, sf_dir: str, variants: tuple[str, ...] | None = None,
              n_files: int | None = None) -> list[str]:
    """Write CSV variants (all unless named; 3 files or more each, by the table's size, or
    ``n_files``) once per state of the tables; returns their folders.

    A variant whose ``_SUCCESS`` marker exists is complete and is not rewritten
    (the files are a pure function of the ``orders`` table)."""
    root = stage_root(spark, sf_dir)
    o = views.table(spark, sf_dir, "orders")
    count = _file_count(spark, sf_dir, "orders")
    if n_files not in (None, count):
        root, count = os.path.join(root, f"files-{n_files}"), n_files
    known = VARIANTS | ODD
    targets = {name: os.path.join(root, "csv", name) for name in variants or known}
    missing = [name for name, target in targets.items() if not _exists(spark, os.path.join(target, "_SUCCESS"))]

    def write(name: str) -> None:
        opt, target = known[name], targets[name]
        frame = _variant_frame(o, name).repartition(count)
        if "order" in opt:
            frame = frame.sortWithinPartitions(*opt["order"])
        trim = str(not opt.get("keep_spaces", False)).lower()
        (frame.write.mode("overwrite").option("sep", opt["sep"]).option("encoding", opt["encoding"])
         .option("header", str(opt["header"]).lower()).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).csv(target))

    # a variant of few files is few tasks, so all are written at the same time
    with ThreadPoolExecutor(max(1, len(missing))) as pool:
        list(pool.map(write, missing))
    return list(targets.values())


#: Folders of the ragged variant, one file each; which row a file spoils depends on these.
RAGGED_PARTS = 32


def stage_ragged(spark: SparkSession, sf_dir: str) -> str:
    """``orders`` as files of ``key,date,price`` without header, dealt by ``key % RAGGED_PARTS``:
    every key divisible by 10 lacks its price, each that leaves 1 has a field too many, and the
    largest key of the odd files has a quote that nothing closes."""
    target = os.path.join(stage_root(spark, sf_dir), "ragged")
    if _exists(spark, os.path.join(target, "_SUCCESS")):
        return target
    o = views.table(spark, sf_dir, "orders")
    key, part = F.col("o_orderkey"), (F.col("o_orderkey") % RAGGED_PARTS).alias("part")
    last = o.groupBy(part).agg(F.max("o_orderkey").alias("last"))
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("%.2f", F.col("o_totalprice"))
    row = (F.when((key == F.col("last")) & (F.col("part") % 2 == 1), F.concat_ws(",", key, day, F.concat(F.lit('"'), price)))
           .when(key % 10 == 0, F.concat_ws(",", key, day)).when(key % 10 == 1, F.concat_ws(",", key, day, price, F.lit("extra")))
           .otherwise(F.concat_ws(",", key, day, price)))
    # the full row first, so that every file has three names
    frame = o.select("*", part).join(last, "part").select("part", row.alias("value"), (key % 10 < 2).alias("bad"))
    frame.repartition(RAGGED_PARTS, "part").sortWithinPartitions("part", "bad").select("part", "value") \
        .write.mode("overwrite").partitionBy("part").option("compression", "none").format("csv") \
        .option("quote", "\u0000").option("sep", "\u0001").option("escapeQuotes", "false").save(target)
    return target


#: Rows of a staged workbook, at most (a sheet can hold 1,048,576 with its header).
BOOK_ROWS = 200_000


def _write_books(target: str, book_rows: int = BOOK_ROWS):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid
        header: list[str] = []

        def all_rows():
            for pdf in batches:
                header[:] = list(pdf.columns)
                for rec in pdf.itertuples(index=False):
                    yield [float(v) if c == "TotalPrice" else str(v) for c, v in zip(header, rec)]

        rows = all_rows()
        while (first := next(rows, None)) is not None:
            os.makedirs(target, exist_ok=True)
            path = os.path.join(target, f"book-{uuid.uuid4().hex}.xlsx")
            written = 0

            def own():
                nonlocal written
                for row in chain([first], islice(rows, book_rows - 1)):
                    written += 1
                    yield row

            with open(path, "wb") as fh:
                write_xlsx(fh, header, own())
            yield pd.DataFrame({"path": [path], "rows": [written]})
    return write


def stage_workbooks(spark: SparkSession, sf_dir: str, books: int = 4) -> str:
    """Workbooks of each partition of orders, written row by row by the task that holds it;
    there are more partitions the larger the table is."""
    root = os.path.join(stage_root(spark, sf_dir), "xlsx")
    if "://" in root and not root.startswith("file:"):
        raise RuntimeError("Workbook staging writes with plain file I/O and needs a POSIX-mounted shared "
                           f"folder; spark.checkpoint.dir is {root!r}.")
    local = root[len("file:"):] if root.startswith("file:") else root
    done = os.path.join(local, "_SUCCESS")
    if os.path.exists(done):
        return local
    if os.path.isdir(local):
        for f in os.listdir(local):
            if f.endswith(".xlsx"):
                os.remove(os.path.join(local, f))
    o = views.table(spark, sf_dir, "orders")
    frame = o.select(F.col("o_orderkey").cast("string").alias("OrderID"),
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("OrderDate"),
                     F.col("o_orderpriority").alias("Priority"), F.col("o_totalprice").alias("TotalPrice"))
    written = frame.repartition(max(books, _file_count(spark, sf_dir, "orders"))).mapInPandas(_write_books(local), "path string, rows long") \
        .agg(F.count(F.lit(1)).alias("books")).first()
    if written and written.books:
        open(done, "w").close()
    return local


def stage_events_csv(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as text CSV files with a signed amount (errors are outflows)."""
    target = os.path.join(stage_root(spark, sf_dir), "events_csv")
    if _exists(spark, os.path.join(target, "_SUCCESS")):
        return target
    ev = views.table(spark, sf_dir, "events")
    signed = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    (ev.select(F.col("ts").cast("string").alias("ts"), F.col("event_type"), signed.cast("string").alias("amount"))
     .repartition(_file_count(spark, sf_dir, "events")).write.mode("overwrite").option("header", "true").csv(target))
    return target
