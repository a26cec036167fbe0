"""File catalog, readers and preview."""

import zipfile

from pyspark.sql import functions as F

from tallyframe.sources import files
from tallyframe.sources.workbook import read_workbooks, xlsx_bytes


def test_catalog_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Дата;Сумма;Категория\n01.01.2026;1 200,50;Продажи\n02.01.2026;300;Аренда\n",
                                    encoding="cp1251")
    (tmp_path / "b.csv").write_text("2026-01-01\t5\tx\n2026-01-02\t7\ty\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("hello")
    cat = {r.name: r for r in files.file_catalog(spark, str(tmp_path)).collect()}
    assert (cat["a.csv"].encoding, cat["a.csv"].delimiter, cat["a.csv"].has_header) == ("cp1251", ";", True)
    assert (cat["b.csv"].encoding, cat["b.csv"].delimiter, cat["b.csv"].has_header) == ("utf-8", "\t", False)
    assert cat["c.csv"].status == "empty" and cat["notes.txt"].status == "unsupported"
    assert cat["a.csv"].size_text.endswith(" B")
    assert (cat["a.csv"].column_count, cat["a.csv"].column_names) == (3, ["Дата", "Сумма", "Категория"])
    assert cat["b.csv"].column_names == ["Column 1", "Column 2", "Column 3"]
    assert (cat["a.csv"].row_count_text, cat["b.csv"].row_count_text) == ("2", "2")
    df = files.read_ledgers(spark, files.file_catalog(spark, str(tmp_path / "a.csv")))
    assert df.columns == ["source_file", "Дата", "Сумма", "Категория"]
    assert [r["Категория"] for r in df.collect()] == ["Продажи", "Аренда"]
    hb = files.read_ledgers(spark, files.file_catalog(spark, str(tmp_path / "b.csv")), columns=["Column 2"])
    assert [r["Column 2"] for r in hb.collect()] == ["5", "7"]


def test_ragged_rows_and_preview(spark, tmp_path):
    lines = ["a,b,c"] + [f"{i},{i * 2}" if i % 10 == 0 else f"{i},{i * 2},{i * 3},extra" for i in range(150)]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    df = files.read_csv(spark, [str(tmp_path / "r.csv")])
    assert df.count() == 150 and df.where(F.col("c").isNull()).count() == 15
    p = files.preview_files(spark, files.file_catalog(spark, str(tmp_path))).collect()
    assert len(p) == 100 and p[0].row_count_text == "100+ (fast preview)"


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Region,Total\n2026-01-01,North,10.50\n2026-01-02,South,1\n")
    (tmp_path / "b.csv").write_text("Total, Date ,Region\n901.25,2026-02-01,South\n")
    (tmp_path / "c.csv").write_text("2026-03-01,5\n2026-03-02,6\n")
    (tmp_path / "d.csv").write_text("2026-04-01,7,east\n")
    (tmp_path / "e.csv").write_text("Total,Total,,_c2\n1,2,3,4\n")
    cat = files.file_catalog(spark, str(tmp_path))
    names = {r.name: r.column_names for r in cat.collect()}
    assert names["b.csv"] == ["Total", "Date", "Region"] and names["d.csv"] == ["Column 1", "Column 2", "Column 3"]
    assert names["e.csv"] == ["Total", "Total 2", "Column 3", "_c2"]
    rows = [r.asDict() for r in files.read_ledgers(spark, cat).collect()]
    by_date = {r["Date"]: (r["Region"], r["Total"]) for r in rows if r["Date"]}
    assert by_date == {"2026-01-01": ("North", "10.50"), "2026-01-02": ("South", "1"), "2026-02-01": ("South", "901.25")}
    assert sorted((r["Column 1"], r["Column 2"], r["Column 3"]) for r in rows if r["Column 1"]) == [
        ("2026-03-01", "5", None), ("2026-03-02", "6", None), ("2026-04-01", "7", "east")]
    assert [(r["Total"], r["Total 2"], r["_c2"]) for r in rows if r["_c2"]] == [("1", "2", "4")]
    some = files.read_ledgers(spark, cat, columns=["Region", "Total"])
    assert some.columns == ["source_file", "Region", "Total"] and some.count() == 7


def test_quotes_and_line_ends_in_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Note,Total\n"He said ""hi"", ok",5.5\n"two\nlines",6\nplain,7\n')
    cat = files.file_catalog(spark, str(tmp_path))
    assert (cat.first().row_count_text, cat.first().multi_line) == ("3", True)
    got = [(r.Note, r.Total) for r in files.read_ledgers(spark, cat).collect()]
    assert got == [('He said "hi", ok', "5.5"), ("two\nlines", "6"), ("plain", "7")]
    preview = [tuple(r.cells) for r in files.preview_files(spark, cat).orderBy("row_no").collect()]
    assert preview == got


def test_encoding_is_decided_on_the_whole_file(spark, tmp_path):
    late = "Kind,Sum\n" + "plain,1\n" * 20_000 + "Аренда,2\n"
    (tmp_path / "late.csv").write_bytes(late.encode("cp1251"))
    (tmp_path / "bom.csv").write_bytes("\ufeffx|y\n1|2\n".encode())
    cat = {r.name: r for r in files.file_catalog(spark, str(tmp_path)).collect()}
    assert cat["late.csv"].encoding == "cp1251" and cat["bom.csv"].encoding == "utf-8"
    assert cat["bom.csv"].column_names == ["x", "y"]
    df = files.read_ledgers(spark, files.file_catalog(spark, str(tmp_path / "late.csv")))
    assert df.where("Kind = 'Аренда'").count() == 1 and df.count() == 20_001


def test_workbook_roundtrip(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    path.write_bytes(xlsx_bytes(["Date", "Amount", "Kind"], [["2026-01-01", 10.5, "x"], ["2026-01-02", 3, "y"]]))
    assert zipfile.is_zipfile(path)
    df = read_workbooks(spark, str(path))
    rows = [(r.Date, r.Amount, r.Kind) for r in df.orderBy("Date").collect()]
    assert rows == [("2026-01-01", "10.5", "x"), ("2026-01-02", "3", "y")]
    headless = tmp_path / "h"
    headless.mkdir()
    (headless / "n.xlsx").write_bytes(xlsx_bytes(["2026-01-01", "5"], [["2026-01-02", "6"]]))
    h = read_workbooks(spark, str(headless))
    assert h.columns == ["source_file", "Column 1", "Column 2"] and h.count() == 2


def test_nothing_selected_is_an_error(spark, tmp_path):
    import pytest
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, [str(tmp_path / "x.csv")], columns=[])
    with pytest.raises(ValueError):
        files.read_csv(spark, [str(tmp_path / "x.csv")], columns=["missing"])


def test_workbook_date_cells(spark, tmp_path):
    """A serial number in a date-formatted cell reads as a date-time text."""
    import io
    import zipfile as zf

    from tallyframe.sources.workbook import parse_first_sheet
    src = io.BytesIO(xlsx_bytes(["Date", "Amount"], [[46023, 5]]))
    out = io.BytesIO()
    with zf.ZipFile(src) as zin, zf.ZipFile(out, "w") as zout:
        for item in zin.namelist():
            data = zin.read(item)
            if item == "xl/worksheets/sheet1.xml":
                data = data.replace(b'<c r="A2"><v>46023</v></c>', b'<c r="A2" s="1"><v>46023.5</v></c>')
            zout.writestr(item, data)
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        zout.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts count="1"><numFmt numFmtId="164" '
                      'formatCode="dd.mm.yyyy hh:mm"/></numFmts><cellXfs count="2"><xf numFmtId="0"/>'
                      '<xf numFmtId="164"/></cellXfs></styleSheet>')
    rows = parse_first_sheet(out.getvalue())
    assert rows == [["Date", "Amount"], ["2026-01-01 12:00:00", "5"]]


def test_file_metrics_one_call(spark, tmp_path):
    from tallyframe.plans.analyze import file_metrics
    from tallyframe.roles import Roles
    (tmp_path / "l.csv").write_text("Date;Income;Cost\n01.01.2026;1 000,50;\n02.01.2026;;250\n", encoding="utf-8")
    m = file_metrics(spark, str(tmp_path), Roles(date="Date", revenue="Income", expense="Cost")).first()
    assert (m.transaction_count, m.total_revenue, m.total_expenses, m.period_days) == (2, 1000.5, 250.0, 2)


def test_fleet_auto_analysis_per_file_roles(spark, tmp_path):
    from tallyframe.plans.analyze import auto_analyze, fleet_analysis
    (tmp_path / "en.csv").write_text("Date,Region,Total\n" + "\n".join(
        f"2026-01-{d:02d},{'North' if d % 2 else 'South'},{100 + d}.50" for d in range(1, 9)) + "\n")
    (tmp_path / "turned.csv").write_text("Total,Date,Region\n" + "\n".join(
        f"{100 + d}.50,2026-01-{d:02d},{'North' if d % 2 else 'South'}" for d in range(1, 9)) + "\n")
    (tmp_path / "ru.csv").write_text("Дата;Категория;Сумма дохода;Сумма расхода\n" + "\n".join(
        f"{d:02d}.01.2026;{'Аренда' if d % 2 else 'Продажи'};{1000 * d};{50 * d}" for d in range(1, 9)) + "\n",
        encoding="cp1251")
    (tmp_path / "words.csv").write_text("note;who\nsome text;ann\nmore text;bob\n")
    fleet = fleet_analysis(spark, files.file_catalog(spark, str(tmp_path)))
    name = lambda r: r.source_file.split("/")[-1]
    basic = {name(r): r for r in fleet.basic.collect()}
    assert set(basic) == {"en.csv", "turned.csv", "ru.csv"}
    assert basic["en.csv"].roles == basic["turned.csv"].roles == "amount=Total, category=Region, date=Date"
    assert basic["ru.csv"].roles == "category=Категория, date=Дата, expense=Сумма расхода, revenue=Сумма дохода"
    assert (basic["ru.csv"].total_revenue, basic["ru.csv"].total_expenses) == (36000.0, 1800.0)
    for f in ("en.csv", "turned.csv"):
        assert (basic[f].total_revenue, basic[f].period_days) == (sum(100.5 + d for d in range(1, 9)), 8)
    assert {(name(r), r.category) for r in fleet.categories.collect()} == {
        (f, c) for f, cs in (("en.csv", ("North", "South")), ("turned.csv", ("North", "South")),
                             ("ru.csv", ("Аренда", "Продажи"))) for c in cs}
    assert fleet.points.count() == 24
    # any keyed table, a null key included
    df = spark.createDataFrame([(k, f"2026-01-{d:02d}", f"{d}.25") for k in ("x", None) for d in range(1, 7)],
                               "shop string, date string, sales string")
    again = auto_analyze(df, ["shop"])
    assert {(r.shop, r.total_revenue) for r in again.basic.collect()} == {("x", 22.5), (None, 22.5)}


def test_preview_files(spark, tmp_path):
    lines = ["a;b;c"] + [f"{i};{i * 2};" for i in range(150)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text("2026-01-01,5\n2026-01-02,7\n")
    cat = files.file_catalog(spark, str(tmp_path))
    p = {(r.source_file.split("/")[-1], r.row_no): r for r in files.preview_files(spark, cat).collect()}
    assert p[("big.csv", 1)].cells == ["0", "0", None] and p[("big.csv", 1)].row_count_text == "100+ (fast preview)"
    assert max(k[1] for k in p if k[0] == "big.csv") == 100
    assert p[("small.csv", 1)].column_names == ["Column 1", "Column 2"] and p[("small.csv", 2)].cells == ["2026-01-02", "7"]
    assert p[("small.csv", 2)].row_count_text == "2"


def test_odd_files_do_not_stop_the_folder(spark, tmp_path, monkeypatch):
    (tmp_path / "good.csv").write_text("Date,Total\n2026-01-01,5\n")
    (tmp_path / "long.csv").write_text('"' + "x, " * 5_000 + '",Total\n1,2\n')
    (tmp_path / "quotes.csv").write_text('"' + '""' * 50_000 + '",Total\n1,2\n')
    (tmp_path / "loose.csv").write_text('a 5" pipe,6" pipe,"x, ""y""",z\n1,2,3,4\n')
    (tmp_path / "open.csv").write_text('Date,Total,"Note\n2026-01-01,5,x\n')
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(5_000)) + "\n" + ",".join("1" * 5_000) + "\n")
    (tmp_path / "lines.csv").write_bytes(b"\n\n\n")
    listed = files.list_files

    def with_a_lost_file(session, paths):
        df = listed(session, paths)
        return df.union(df.limit(1).withColumn("path", F.lit("file:/nowhere/lost.csv")).withColumn("name", F.lit("lost.csv")))

    monkeypatch.setattr(files, "list_files", with_a_lost_file)
    cat = {r.name: r for r in files.file_catalog(spark, str(tmp_path)).collect()}
    assert cat["lost.csv"].status == "error"
    assert {n: r.status for n, r in cat.items() if n != "lost.csv"} == dict.fromkeys(
        ["good.csv", "long.csv", "quotes.csv", "loose.csv", "open.csv", "wide.csv", "lines.csv"], "ok")
    assert cat["good.csv"].column_names == ["Date", "Total"] and cat["good.csv"].records == 1
    assert cat["long.csv"].column_names == [("x, " * 5_000).strip(), "Total"]
    assert cat["quotes.csv"].column_names == ['"' * 50_000, "Total"]
    assert cat["loose.csv"].column_names == ['a 5" pipe', '6" pipe', 'x, "y"', "z"]
    assert cat["open.csv"].column_count == 3 and cat["open.csv"].odd_quotes and not cat["open.csv"].multi_line
    assert cat["wide.csv"].column_count == 5_000 and cat["lines.csv"].column_count == 0


def test_an_unclosed_quote_is_reported_and_takes_no_other_line(spark, tmp_path):
    rows = [f"2026-01-{d:02d},{d},x" for d in range(1, 29)]
    rows[9] = '2026-01-10,10,"never closed'
    rows[3] = "2026-01-04,4"
    rows[20] = "2026-01-21,21,x,y,z"
    rows[21] = '2026-01-22,22,"a, b",y'
    (tmp_path / "a.csv").write_text("Date,Total,Note\n" + "\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text('Date,Total,Note\n2026-02-01,1,"two\nlines"\n2026-02-02,2,x\n')
    cat = files.file_catalog(spark, str(tmp_path))
    got = {r.source_file.split("/")[-1]: tuple(r)[1:] for r in files.record_issues(spark, cat).collect()}
    assert got == {"a.csv": (28, 1, 2, True, 0), "b.csv": (2, 0, 0, False, 1)}
    total = files.read_ledgers(spark, cat).selectExpr("sum(cast(Total as int))").first()[0]
    assert total == sum(range(1, 29)) + 3


def test_kept_catalog_reads_only_new_and_changed_files(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "in", str(tmp_path / "kept")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"Date,Total\n2026-01-0{i + 1},5\n")
    (folder / "n.txt").write_text("x")
    read = []
    judged = files._judged
    monkeypatch.setattr(files, "_judged", lambda s, f, paths, h: read.append(sorted(p.split("/")[-1] for p in paths))
                        or judged(s, f, paths, h))

    def names():
        return {r.name: (r.status, r.column_names) for r in files.file_catalog(spark, str(folder), kept=kept).collect()}

    first = names()
    assert first["0.csv"] == ("ok", ["Date", "Total"]) and first["n.txt"] == ("unsupported", None)
    assert read == [["0.csv", "1.csv", "2.csv"]]
    assert names() == first and len(read) == 1  # nothing is judged again
    (folder / "1.csv").write_text("When,Total,Kind\n2026-01-01,5,a\n")
    (folder / "3.csv").write_text("a,b\nc,d\n")
    (folder / "2.csv").unlink()
    again = names()
    assert read[1:] == [["1.csv", "3.csv"]]
    assert set(again) == {"0.csv", "1.csv", "3.csv", "n.txt"} and again["1.csv"][1] == ["When", "Total", "Kind"]


def test_large_files_are_previewed_from_their_start(spark, tmp_path):
    (tmp_path / "big.csv").write_bytes(b"Date,Total\n" + b"2026-01-01,5\n" * 1_000_000)
    (tmp_path / "late.csv").write_bytes(b"Kind,Total\n" + b"plain,1\n" * 500_000 + "Аренда,2\n".encode("cp1251"))
    cat = files.file_catalog(spark, str(tmp_path), heads_only=True)
    rows = {r.name: r for r in cat.collect()}
    assert rows["big.csv"].row_count_text == "100+ (fast preview)" and rows["big.csv"].records is None
    assert rows["late.csv"].encoding == "utf-8"  # what lies behind the head is not read
    p = files.preview_files(spark, cat)
    assert p.groupBy("source_file").agg(F.count("*").alias("n"), F.max("row_no").alias("m")).select("n", "m").distinct().collect() == [(100, 100)]
    seen = []
    raw = spark.read.text(str(tmp_path / "big.csv")).select(F.lit("p").alias("path"), F.col("value").cast("binary").alias("value"))
    seen = files._first_lines(raw.coalesce(1)).first()
    assert not seen.whole and seen.lines < 100_000 and len(seen.head) == files.DELIMITER_SAMPLE_LINES


def test_workbooks_are_written_and_read_in_parts(tmp_path):
    import pandas as pd
    from tallyframe.plans import staging
    from tallyframe.sources import workbook

    batches = (pd.DataFrame({"OrderID": [str(i) for i in range(a, a + 700)], "TotalPrice": [i + 0.5 for i in range(a, a + 700)]})
               for a in range(0, 7000, 700))
    books = pd.concat(staging._write_books(str(tmp_path), book_rows=3000)(batches))
    assert books["rows"].tolist() == [3000, 3000, 1000]
    contents = [open(p, "rb").read() for p in books["path"]]
    # a workbook cut off within its sheet has no rows and leaves the others alone
    pdf = pd.DataFrame({"path": [*books["path"], "cut"], "content": [*contents, contents[0][:-400]]})
    parts = list(workbook._parser(None)(iter([pdf])))
    assert max(len(p) for p in parts) <= workbook.SHEET_BATCH and set(pd.concat(parts)["path"]) == set(books["path"])
    rows = pd.concat(parts)
    assert sorted(rows[rows["row_no"] > 0]["cells"].map(tuple), key=lambda c: int(c[0])) == [
        (str(i), str(i + 0.5)) for i in range(7000)]
    assert rows[rows["path"] == books["path"].iloc[0]]["row_no"].tolist() == list(range(3001))


def test_staged_files_grow_in_number_with_the_rows(spark, monkeypatch):
    from tallyframe.plans import staging
    from tests.conftest import SF001

    monkeypatch.setattr(staging, "FILE_ROWS", 100)
    monkeypatch.setattr(staging, "stage_root", lambda spark, sf: staging.shared_path(spark, "test-staged", "by-rows"))
    rows = spark.read.parquet(f"{SF001}/orders.parquet").count()
    by_rows, three = (spark.read.text(staging.stage_csv(spark, SF001, ("pipe",), n)[0])
                      .groupBy(F.col("_metadata.file_path")).count().collect() for n in (None, 3))
    assert len(by_rows) == -(-rows // 100) > 3 and max(r["count"] for r in by_rows) <= 102
    assert len(three) == 3 and sum(r["count"] for r in three) == rows + 3


def test_first_lines_read_no_whole_file(spark, tmp_path):
    """A task is handed a file's first lines only; behind a Python function that ends early it
    used to read on, by chance, to the end of the file."""
    assert files._first_of_each_task(spark.range(0, 4000, 1, 4), 3).count() == 12
    (tmp_path / "long.csv").write_text("Date,Total\n" + "2026-01-01,5\n" * 3_000 + "\n" * files.HEAD_LINES + "2026-01-02,6\n")
    head = files._first_lines(files._starts(files._one_file_a_task(spark), [str(tmp_path)])).first()
    assert (head.lines, head.whole, len(head.head)) == (3_001, False, 20)
    assert files.file_catalog(spark, str(tmp_path)).first().records == 3_001


def test_first_lines_of_files_in_several_pieces(spark, tmp_path, monkeypatch):
    """Where a session's file pieces cannot be set, only the piece at a file's start has its first lines."""
    (tmp_path / "a.csv").write_text("Date,Total\n" + "2026-01-01,5\n" * 20_000)
    sub = spark.newSession()
    sub.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    monkeypatch.setattr(files, "_one_file_a_task", lambda _: sub)
    found = files.file_catalog(spark, str(tmp_path)).collect()
    assert [(r.column_names, r.records) for r in found] == [(["Date", "Total"], 20_000)]


def test_variants_are_staged_once_and_whole(spark, tmp_path):
    import shutil
    from pathlib import Path

    from tallyframe.plans import staging
    from tests.conftest import SF001
    for table in ("orders", "events"):  # tables of their own, which nothing is staged from yet
        shutil.copyfile(f"{SF001}/{table}.parquet", tmp_path / f"{table}.parquet")
    sf, variants = str(tmp_path), tuple(staging.VARIANTS)
    folders = staging.stage_csv(spark, sf, variants, 2)
    written = lambda: [sorted(f.name for f in Path(d).glob("*.csv")) for d in folders]
    names = written()
    assert [d.rsplit("/", 1)[1] for d in folders] == list(variants) and all(len(x) == 2 for x in names)
    rows = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert files.file_catalog(spark, folders).groupBy().sum("records").first()[0] == rows * len(variants)
    assert staging.stage_csv(spark, sf, variants, 2) == folders and written() == names
