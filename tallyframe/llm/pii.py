"""Format-preserving pseudonyms for personal data, with built-in functions only.

Emails, IPv4 addresses, dates, social security numbers, phone numbers and payment
cards are found by one pattern, validated (octets, calendar, area numbers, digit
counts, Luhn sum), and replaced in place. Numbers and dates are permuted by a keyed
Feistel network on exactly the values of their format, so a valid value becomes
another valid value of the same shape, different values stay different, and equal
values stay equal in all documents:

* card: all digits but the last, then a new check digit; separators stay;
* phone: the last ten digits (fewer: all); country code and punctuation stay;
* IPv4: the 32-bit address;
* social security number: area, group and serial within their valid ranges;
* date (``2024-01-31``, ``31.01.2024``, ``01/31/2024``, else ``31/01/2024``; hyphens and
  slashes in each order, one-digit days and months, the month's English name): the day
  within its stretch of 73,000 days counted from 1900-01-01, written in the same form.

An email is no number; it becomes a keyed digest in the reserved domain
``example.invalid``. A value that fails its validation stays as it is.

A Feistel round adds a keyed SHA-256 of the one half to the other, modulo the other's
range; with halves of ranges ``a`` and ``b`` that permutes exactly ``a * b`` values,
without cycle walking.

Defined cases: null text stays null, empty text empty; all other columns, rows and
their order within a row are untouched, whatever their names; an empty table gives no
rows; values may repeat as often as they like, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of a corpus is a secret of its owner; this one is for tests and examples.
KEY = "change-me"
ROUNDS = 8
DAYS = (365, 200)
EPOCH = "1900-01-01"

MONTH = ("(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         "|nov(?:ember)?|dec(?:ember)?)")
NTH = "(?i:st|nd|rd|th)?"
#: The kinds, in the order in which they are tried at a position. Every repeated group is
#: bounded (a domain has 127 labels of 63 characters at most): the pattern matcher takes
#: a stack frame per repetition of a group, so junk of any length must not repeat one freely.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4})(?![0-9]|[./-][0-9])"
            rf"|(?<![0-9A-Za-z./-])(?:{MONTH}\.? [0-9]{{1,2}}{NTH},? [0-9]{{4}}"
            rf"|[0-9]{{1,2}}{NTH}(?: of)?[ -]{MONTH}\.?,?[ -][0-9]{{4}})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    # national by threes; with country code, first without separators; in brackets; trunk 0; ten bare digits
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-]|(?<![0-9][ .,/-])[0-9]{3} )[0-9]{3}[ .-][0-9]{4}"
             r"|\+[0-9]{8,15}(?![0-9])|\+[0-9](?:[ .()/-]{0,3}[0-9]){7,14}"
             r"|\([0-9]{2,5}\)(?:[ .-]?[0-9]){6,8}"
             r"|(?<![0-9][ .,/-])(?:00[1-9](?:[ .()/-]{0,3}[0-9]){7,12}|0[1-9](?:[ .-]?[0-9]){7,10}|[2-9][0-9]{2}[2-9][0-9]{6})"
             r"(?![0-9A-Za-z]|[.,-][0-9]))(?![0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])",
}
#: Back references keep their number: only the card pattern has a capturing group.
ANY = "|".join(PATTERNS.values())


def _round(key: str, kind: str, i: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), i.cast("string"),
                                half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """struct(l, r): the keyed permutation of ``(left, right)`` in ``[0, a) x [0, b)``."""
    size = a * b
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (l + _round(key, kind, i, r, size) % a) % a).otherwise(l).cast("long").alias("l"),
            F.when(odd, r).otherwise((r + _round(key, kind, i, l, size) % b) % b).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _pad(n: Column, width) -> Column:
    return F.lpad(n.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ten_to(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("long")


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    low = n - half
    a, b = _ten_to(half), _ten_to(low)
    return F.transform(F.array(feistel(F.substring(d, F.lit(1), half).cast("long"),
                                       F.substring(d, half + 1, low).cast("long"), a, b, key, kind)),
                       lambda p: F.concat(_pad(p["l"], half), _pad(p["r"], low)))[0]


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits``, one for one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["k"] + 1, F.lit(1))).otherwise(c))
                        .alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(m)), start, step, lambda acc: acc["out"])


def _luhn_sum(d: Column, doubled_from_last: int) -> Column:
    """Sum of the digits, those at an odd distance from the end plus
    ``doubled_from_last`` doubled (less 9 over 9)."""
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = (n - i + F.lit(doubled_from_last)) % 2 == 1
        return acc + F.when(twice, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        head = _permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(head, lambda h: _refill(m, F.concat(h, F.pmod(-_luhn_sum(h, 1), F.lit(10)).cast("string"))))
    d = _digits(m)
    return F.when((_luhn_sum(d, 0) % 10 == 0) & (F.ltrim(F.translate(d, "0", " ")) != ""), _let(d, of))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    k = F.least(n, F.lit(10))
    return F.when(n.between(8, 15), _refill(m, F.concat(
        F.substring(d, F.lit(1), n - k), _permuted_digits(F.substring(d, n - k + 1, k), key, "phone"))))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    word = F.lit(65536).cast("long")
    new = _let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], word, word, key, "ipv4"),
               lambda p: F.concat_ws(".", *[F.floor(h / 256).cast("string") if top else (h % 256).cast("string")
                                            for h in (p["l"], p["r"]) for top in (True, False)]))
    return F.when(F.forall(o, lambda x: x <= 255), new)


def _ssn(m: Column, key: str) -> Column:
    # areas 1 to 899 but 666; groups 1 to 99; serials 1 to 9999
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    nth = area - 1 - (area > 666).cast("int")
    a, b = F.lit(898).cast("long"), F.lit(99 * 9999).cast("long")
    new = _let(feistel(nth, (group - 1) * 9999 + serial - 1, a, b, key, "ssn"), lambda p: F.concat_ws(
        "-", _pad(p["l"] + 1 + (p["l"] >= 665).cast("int"), 3), _pad(F.floor(p["r"] / 9999) + 1, 2),
        _pad(p["r"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new)


def _moved_day(day: Column, form: str, key: str) -> Column:
    """Another day of the same stretch of 73,000; the padded ``form`` is part of the key."""
    a, b = DAYS

    def of(days: Column) -> Column:
        base = F.floor(days / (a * b)) * (a * b)
        at = days - base
        moved = feistel(F.floor(at / b), at % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, "date" + form)
        return _let(moved, lambda p: F.date_add(F.lit(EPOCH).cast("date"), (base + p["l"] * b + p["r"]).cast("int")))
    return F.when(F.year(day).between(1, 9800), _let(F.datediff(day, F.lit(EPOCH).cast("date")), of))


def _day(y: Column, m: Column, d: Column) -> Column:
    # a day that the calendar lacks is null
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date")


def _date(m: Column, key: str) -> Column:
    out = _named_date(m, key)
    p = F.split(m, "[./-]")
    for sep in "./-":
        mark = "[.]" if sep == "." else sep
        last = [("dd", "MM", "yyyy"), ("MM", "dd", "yyyy")]
        # the later form goes first: month before day, but not between dots
        for parts in [("yyyy", "MM", "dd"), *(last[:1] if sep == "." else last)]:
            year_first = parts[0] == "yyyy"
            shape = f"^[0-9]{{4}}{mark}" if year_first else f"^[0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark}"
            day = F.when(m.rlike(shape), _day(*(F.get(p, parts.index(x)) for x in ("yyyy", "MM", "dd"))))
            form = sep.join(parts)
            short = sep.join(x if x == "yyyy" else x[0] for x in parts)
            # a day or month of one digit: neither is padded
            out = F.coalesce(_let(_moved_day(day, form, key), lambda new: F.when(
                F.length(m) == 10, F.date_format(new, form)).otherwise(F.date_format(new, short))), out)
    return out


def _named_date(m: Column, key: str) -> Column:
    """Dates with the month's name: its length and case, ordinals and punctuation stay."""
    name = F.regexp_extract(m, f"({MONTH})(?![a-z])", 1)
    of = F.regexp_extract(m, "([0-9]{1,2})(?![0-9])", 1)
    nth = F.floor((F.position(F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)
    day = F.when(name != "", _day(F.substring(m, -4, 4), nth.cast("string"), of))

    def written(new: Column) -> Column:
        full = (F.length(name) > 4) | F.lower(name).isin("may", "june", "july")
        month = F.when(full, F.date_format(new, "MMMM")).otherwise(F.date_format(new, "MMM"))
        month = F.when(name == F.upper(name), F.upper(month)).when(name == F.lower(name), F.lower(month)).otherwise(month)
        d = F.dayofmonth(new)
        number = F.when(of.startswith("0"), F.date_format(new, "dd")).otherwise(d.cast("string"))
        suffix = (F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd")
                  .otherwise("th"))
        # what lies between: blanks, commas, points, hyphens, "of"
        first, second = (F.regexp_extract(m, f"^(?:{MONTH}|[0-9]{{1,2}}(?i:st|nd|rd|th)?)((?: of)?[ .-]+)"
                                             f"(?:{MONTH}|[0-9]{{1,2}}(?i:st|nd|rd|th)?)([ .,-]+)[0-9]{{4}}$", k) for k in (1, 2))
        number = F.when(m.rlike("[0-9](?i:st|nd|rd|th)"), F.concat(number, suffix)).otherwise(number)
        front = m.rlike("^[0-9]")
        return F.concat(F.when(front, number).otherwise(month), first, F.when(front, month).otherwise(number), second,
                        F.date_format(new, "yyyy"))
    return _let(_moved_day(day, "d MMMM yyyy", key), written)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("|email|"), m), 256), 1, 20),
                    F.lit("@example.invalid"))


REPLACE = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; null if it fails validation."""
    out = F.lit(None).cast("string")
    for kind in reversed(list(PATTERNS)):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), REPLACE[kind](m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced; ``count`` names a new
    column for the number of values replaced."""
    text = F.col(f"`{column}`")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # only texts with a digit or an @ are searched
    matches = F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast("array<string>"))
    names = docs.columns
    out = (docs.withColumn("__pii_found", matches)
           .withColumn("__pii_new", F.transform("__pii_found", lambda m: pseudonym(m, key))))
    filled = F.zip_with(F.split(text, ANY, -1), F.zip_with("__pii_found", "__pii_new", lambda m, p: F.coalesce(p, m)),
                        lambda part, value: F.concat(part, F.coalesce(value, F.lit(""))))
    out = out.withColumn("__pii_text", F.when(F.size("__pii_found") > 0, F.array_join(filled, "")).otherwise(text))
    columns = [F.col("__pii_text").alias(n) if n == column else F.col(f"`{n}`") for n in names if n != count]
    if count:
        columns.append(F.coalesce(F.size(F.filter("__pii_new", lambda p: p.isNotNull())), F.lit(0)).cast("long").alias(count))
    return out.select(*columns)
