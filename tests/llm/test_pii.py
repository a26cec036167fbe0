import datetime
import hashlib
import re

from pyspark.sql import functions as F

from tallyframe.llm import pii
from tests.conftest import SF001
from tests.llm.helpers import docs, with_clashes

KEY = "k"


def feistel(left, right, a, b, kind):
    def add(i, half):
        text = "|".join([KEY, kind, str(a * b), str(i), str(half)])
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + add(i, right) % a) % a
        else:
            right = (right + add(i, left) % b) % b
    return left, right


def digits_of(d, kind):
    h = len(d) // 2
    x, y = feistel(int(d[:h] or 0), int(d[h:]), 10 ** h, 10 ** (len(d) - h), kind)
    return str(x).zfill(h) + str(y).zfill(len(d) - h)


def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def refill(m, d):
    it = iter(d)
    return "".join(next(it) if c.isdigit() else c for c in m)


def brute(m):
    """The pseudonym by plain Python, None if the value is not valid."""
    d = re.sub(r"\D", "", m)
    if "@" in m:
        return "u" + hashlib.sha256(f"{KEY}|email|{m}".encode()).hexdigest()[:20] + "@example.invalid"
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return None
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for shape, form, spark_form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d", "yyyy-MM-dd"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y", "dd.MM.yyyy"),
                                    (r"\d\d/\d\d/\d{4}", "%m/%d/%Y", "MM/dd/yyyy"), (r"\d\d/\d\d/\d{4}", "%d/%m/%Y", "dd/MM/yyyy")):
        if re.fullmatch(shape, m):
            try:
                day = datetime.datetime.strptime(m, form).date()
            except ValueError:
                continue
            n = (day - datetime.date(1900, 1, 1)).days
            base = n // 73000 * 73000
            x, y = feistel((n - base) // 200, (n - base) % 200, 365, 200, "date" + spark_form)
            return (datetime.date(1900, 1, 1) + datetime.timedelta(base + x * 200 + y)).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        x, y = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if re.match(r"[+(]|\d{3}[.-]", m):
        k = min(len(d), 10)
        return refill(m, d[:-k] + digits_of(d[-k:], "phone")) if 8 <= len(d) <= 15 else None
    if re.match(r"\d", m) and 13 <= len(d) <= 19 and luhn(d) and d.strip("0"):
        head = digits_of(d[:-1], "card")
        return refill(m, next(head + str(c) for c in range(10) if luhn(head + str(c))))
    return None


VALID = ["bob.42@mail8.example.com", "42.144.35.254", "0.0.0.0", "4041894974608795", "4041 8949 7460 8795", "378282246310005",
         "3782 822463 10005", "+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+33 6 12 34 56 78", "123-45-6789",
         "899-99-9999", "1985-02-28", "28.02.1985", "02/28/1985", "28/02/1985", "2024-02-29", "1899-12-31", "2150-01-01"]
INVALID = ["999.1.1.1", "4041894974608796", "0000000000000000", "000-12-3456", "666-12-3456", "1985-02-30", "31/31/2020",
           "1.2.3.4.5", "v2.0", "12345", "a@b", "2485", "20,000"]


def test_pseudonyms_match_plain_python(spark):
    for m in VALID:
        assert brute(m) not in (None, m)
    table = [(k, m) for k, m in enumerate(VALID + INVALID)]
    table += [(100 + k, f"é {m}, then {m} again") for k, m in enumerate(VALID + INVALID)]
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(docs(spark, table), KEY, count="n").collect()}
    for k, m in enumerate(VALID + INVALID):
        new = brute(m) if m in VALID else None
        assert got[k] == (new or m, int(new is not None)), m
        assert got[100 + k] == (f"é {new or m}, then {new or m} again", 2 * int(new is not None)), m


def test_neighbouring_values_and_untouched_columns(spark):
    table = [(1, "+1 (988) 555-2485 4041894974608795 bob.42@mail8.example.com 42.144.35.254"), (1, None), (None, ""),
             (2, "nothing here"), (3, "x " * 200_000 + "42.144.35.254"), (2, "nothing here")]
    df = with_clashes(docs(spark, table), "m", "found", "l", "n_replaced2")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    text = [r.text for r in out.collect()]
    assert text[0] == " ".join([brute("+1 (988) 555-2485"), brute("4041894974608795"), brute("bob.42@mail8.example.com"),
                                brute("42.144.35.254")])
    assert text[1] is None and text[2] == "" and text[3] == text[5] == "nothing here"
    assert text[4].endswith(brute("42.144.35.254")) and len(text[4]) > 400_000
    assert pii.pseudonymise(docs(spark, []), KEY).count() == 0


def test_network_is_a_permutation(spark):
    n = spark.range(35 * 20).select(pii.feistel(F.floor(F.col("id") / 20), F.col("id") % 20, F.lit(35).cast("long"),
                                                F.lit(20).cast("long"), "k", "t").alias("p"))
    assert n.where("p.l between 0 and 34 and p.r between 0 and 19").select("p.l", "p.r").distinct().count() == 700


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    before = {r.doc_id: r.text for r in df.collect()}
    kinds = re.compile(r"[a-z.]+\d*@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|\b4\d{15}\b")
    seen = 0
    for r in pii.pseudonymise(df, KEY, count="n").collect():
        old = kinds.findall(before[r.doc_id] or "")
        seen += len(old)
        assert not any(x in r.text for x in old)
        if not old:
            assert r.text == before[r.doc_id]
    assert seen > 5
    plan = pii.pseudonymise(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PHONES = ["+15558675309", "+442071838750", "555 867 5309", "5558675309", "+33 612345678", "+86 13912345678",
          "+44 (0)20 7183 8750", "+44 20 71838750", "+4915112345678", "+1 (017) 555-7713", "(555) 8675309", "0612345678",
          "06 12 34 56 78", "020 7183 8750", "0151 12345678", "0033612345678", "+49-30-1234567", "(020) 7183 8750"]
#: date, its day, the key's form, and how the new day is written
DATES = [("1/5/2024", (2024, 1, 5), "MM/dd/yyyy", "{m}/{d}/{y}"), ("5.1.2024", (2024, 1, 5), "dd.MM.yyyy", "{d}.{m}.{y}"),
         ("25/1/2024", (2024, 1, 25), "dd/MM/yyyy", "{d}/{m}/{y}"), ("2024/01/05", (2024, 1, 5), "yyyy/MM/dd", "{y}/{m:02}/{d:02}"),
         ("2024/1/5", (2024, 1, 5), "yyyy/MM/dd", "{y}/{m}/{d}"), ("2024-1-5", (2024, 1, 5), "yyyy-MM-dd", "{y}-{m}-{d}"),
         ("31-01-2024", (2024, 1, 31), "dd-MM-yyyy", "{d:02}-{m:02}-{y}"),
         ("January 5, 2024", (2024, 1, 5), "d MMMM yyyy", "{B} {d}, {y}"), ("Jan. 05 2024", (2024, 1, 5), "d MMMM yyyy", "{b}. {d:02} {y}"),
         ("5 Jan 2024", (2024, 1, 5), "d MMMM yyyy", "{d} {b} {y}"), ("5-JAN-2024", (2024, 1, 5), "d MMMM yyyy", "{d}-{b2} {y}"),
         ("31 Sept. 2024", None, "", ""), ("2024/02/30", None, "", ""), ("13/13/2024", None, "", "")]


def test_common_phone_and_date_forms(spark):
    want = {}
    for m in PHONES:
        d = re.sub(r"\D", "", m)
        want[m] = refill(m, d[:-10] + digits_of(d[-10:], "phone"))
    for m, ymd, form, written in DATES:
        want[m] = m
        if ymd:
            n = (datetime.date(*ymd) - datetime.date(1900, 1, 1)).days
            x, y = feistel(n // 200, n % 200, 365, 200, "date" + form)
            new = datetime.date(1900, 1, 1) + datetime.timedelta(x * 200 + y)
            want[m] = written.replace("{b2} ", "{b2}-").format(y=new.year, m=new.month, d=new.day, B=new.strftime("%B"),
                                                               b=new.strftime("%b"), b2=new.strftime("%b").upper())
    same = ["3.5558675309", "1700000000", "5558675309.25", "a5558675309", "555-1234", "1/5/24", "May 2024", "version 1.2.3"]
    want |= {m: m for m in same}
    got = pii.pseudonymise(docs(spark, [(k, f"at {m}, or") for k, m in enumerate(want)]), KEY).collect()
    assert {m: got[k].text for k, m in enumerate(want)} == {m: f"at {new}, or" for m, new in want.items()}


def test_a_million_repetitions_of_each_pattern_part(spark):
    """Junk that repeats a part of a pattern neither overflows the matcher's stack nor hangs."""
    n = 1_000_000
    parts = ["a.", "a@", "a-", "1.", "1-", "1/", "1 ", "(1", "+1", "(12)", "1)", "0", "a", ".", "+", "may ", "1st ", "12 of ", "a1."]
    given = [(i, head + part * n + tail) for i, (part, head, tail) in enumerate(
        [(p, h, t) for p in parts for h, t in (("", ""), ("see x@", " b@c.org"))])]
    short = [(1000, "see x@" + "a." * 2000 + "com"), (1001, "x@" + "b" * 64 + ".org"), (1002, "x@" + "a." * 100 + "com")]
    df = docs(spark, given + short).repartition(8)
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY, count="n").selectExpr(
        "doc_id", "n", "length(text) as size", "right(text, 40) as tail").collect()}
    assert len(got) == len(given) + len(short)
    assert got[1002].n == 1 and got[1001].n == 0
    for i, text in given:
        if text.endswith(" b@c.org"):
            assert "@example.invalid" in got[i].tail and got[i].n >= 1


def test_long_domains_are_found_up_to_their_bounds(spark):
    mails = ["x@" + "a" * 63 + ".org", "x@" + "ab." * 126 + "com", "first.last+tag@mail.example.co.uk"]
    got = pii.pseudonymise(docs(spark, list(enumerate(mails))), KEY, count="n").collect()
    assert all(r.n == 1 and r.text.endswith("@example.invalid") for r in got)
