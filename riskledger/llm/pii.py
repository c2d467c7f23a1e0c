"""Operator 2, personal data under format-preserving pseudonyms (DataFrame functions only).

Numbers, dates and secrets that pass their format's own check are replaced by a
keyed permutation inside that format: a Feistel network over the two halves of
their digits or characters. Equal values get equal pseudonyms in all documents,
so links between documents stay; check digits are computed anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm._common import let, table

ROUNDS = 4
#: The formats, in the order in which a place in the text is tried.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "password": r"(?i:\b(?:password|passwd|pwd|secret|api_key|token))(?:=[A-Za-z0-9]{6,}|[ \t]*=[ \t]*(?:[\"'][^\s\"']{6,}|(?=[A-Za-z]*\d)[A-Za-z0-9]{6,}))",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}[/.]\d{2}[/.]\d{4}\b",
    "phone": r"(?<![\d-])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DAY0, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days are the years 1900 to 2099


def prf(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel_number(x: Column, a: int, b: int, key: str) -> Column:
    """A keyed permutation of the numbers 0 to a * b - 1."""

    def step(r: int) -> Callable[[Column], Column]:
        left = lambda v: F.struct(F.pmod(v["l"] + prf(key, F.lit(2 * r), v["r"]), F.lit(a)).alias("l"), v["r"].alias("r"))
        right = lambda v: F.struct(v["l"].alias("l"), F.pmod(v["r"] + prf(key, F.lit(2 * r + 1), v["l"]), F.lit(b)).alias("r"))
        return lambda v: let(left(v), right)

    v = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    for r in range(ROUNDS):
        v = let(v, step(r))
    return let(v, lambda v: v["l"] * b + v["r"])


def feistel_text(s: Column, key: str) -> Column:
    """A keyed permutation of the texts with s's pattern: each digit stays a digit, each
    small letter small, each capital a capital; all other characters stay themselves."""

    def moved(half: Column, by: Column, r: int) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = lambda base, n: F.char(F.pmod(F.ascii(c) - base + prf(key, F.lit(r), by, i, F.length(half)), F.lit(n)) + base)
            return F.when(c.between("0", "9"), shift(48, 10)).when(c.between("a", "z"), shift(97, 26)).when(c.between("A", "Z"), shift(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(r: int) -> Callable[[Column], Column]:
        left = lambda v: F.struct(moved(v["l"], v["r"], 2 * r).alias("l"), v["r"].alias("r"))
        right = lambda v: F.struct(v["l"].alias("l"), moved(v["r"], v["l"], 2 * r + 1).alias("r"))
        return lambda v: let(left(v), right)

    half = F.floor((F.length(s) + 1) / 2).cast("int")
    v = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    for r in range(ROUNDS):
        v = let(v, step(r))
    return let(v, lambda v: F.concat(v["l"], v["r"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(d), ""), value), F.lit(0), lambda s, x: s + x)


def in_format(original: Column, new: Column) -> Column:
    """The digits of new in the places of original's digits."""
    put = lambda acc, c: F.when(c.rlike(r"\d"), F.struct(F.concat(acc["t"], F.substring(new, acc["i"], F.lit(1))).alias("t"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["i"].alias("i")))
    return F.aggregate(F.split(original, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), put, lambda acc: acc["t"])


def card_runs(m: Column) -> Column:
    """Where Luhn-valid numbers of 13 to 19 digits lie in a match, longest first: array of
    (length, start) over all runs of its groups of digits."""

    def of(groups: Column) -> Column:
        ends = F.transform(groups, lambda g, i: F.aggregate(F.slice(groups, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x) + 1))
        runs = lambda ends: F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.transform(F.slice(ends, i + 1, F.size(ends)), lambda e: let(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda s: F.struct((e - 1 - s).alias("length"), s.alias("start"))))))
        valid = lambda r: let(digits(F.substring(m, r["start"] + 1, r["length"])), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))
        return let(ends, lambda e: F.sort_array(F.filter(runs(e), valid), asc=False))

    return let(F.split(m, "[ -]"), of)


def card(m: Column, key: str) -> Column:
    """Luhn-valid numbers, with or without other groups of digits beside them: the first digit
    stays, the last is the new check digit."""

    def changed(number: Column) -> Column:
        d = digits(number)
        body = lambda d: F.concat(F.substring(d, 1, 1), feistel_text(F.substring(d, F.lit(2), F.length(d) - 2), key + "card"))
        checked = lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
        return in_format(number, let(let(d, body), checked))

    def replaced(run: Column) -> Column:
        number = F.substring(m, run["start"] + 1, run["length"])
        after = run["start"] + run["length"]
        return F.concat(F.substring(m, F.lit(1), run["start"]), let(number, changed), F.substring(m, after + 1, F.length(m)))

    return let(F.get(card_runs(m), 0), lambda r: F.when(r.isNotNull(), replaced(r)).otherwise(m))


def phone(m: Column, key: str) -> Column:
    """Ten-digit numbers, written in groups; a country code stays."""

    def changed(d: Column) -> Column:
        build = lambda y: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.lpad(y.cast("string"), 10, "0"))
        return in_format(m, let(feistel_number(F.substring(d, -10, 10).cast("long"), 100_000, 100_000, key + "phone"), build))

    return let(digits(m), changed)


def ssn(m: Column, key: str) -> Column:
    """Social security numbers with valid area (not 000, 666, 9xx), group and serial."""
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    x = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1).cast("long") * 9999 + serial - 1
    def build(y: Column) -> Column:
        top = F.floor(y / (99 * 9999)) + 1
        parts = (F.when(top >= 666, top + 1).otherwise(top), 3), (F.pmod(F.floor(y / 9999), F.lit(99)) + 1, 2), (F.pmod(y, F.lit(9999)) + 1, 4)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.when(valid, let(feistel_number(x, 898 * 99, 9999, key + "ssn"), build)).otherwise(m)


def ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    build = lambda y: F.concat_ws(".", *[F.pmod(F.floor(y / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.greatest(*[part(i) for i in (1, 2, 3, 4)]) < 256, let(feistel_number(x, 65536, 65536, key + "ipv4"), build)).otherwise(m)


def date(m: Column, key: str) -> Column:
    """Days of 1900 to 2099, written year first, or day (or month, where only that is valid) first."""

    def changed(pattern: str) -> Callable[[Column], Column]:
        back = lambda y: F.date_format(F.date_add(F.lit(DAY0).cast("date"), y.cast("int")), pattern)
        return lambda x: F.when(x.between(0, DAYS[0] * DAYS[1] - 1), let(feistel_number(x, *DAYS, key + "date"), back)).otherwise(m)

    def day(*order: int) -> Column:
        iso = F.concat_ws("-", *[F.element_at(F.split(m, "[-/.]"), i) for i in order])
        return F.datediff(iso.try_cast("date"), F.lit(DAY0).cast("date")).cast("long")

    sep = F.substring(m, 3, 1)
    kinds = F.when(m.rlike(r"^\d{4}-") & day(1, 2, 3).isNotNull(), let(day(1, 2, 3), changed("yyyy-MM-dd")))
    for order, fmt in (((3, 2, 1), "dd{0}MM{0}yyyy"), ((3, 1, 2), "MM{0}dd{0}yyyy")):
        for s in "/.":
            kinds = kinds.when((sep == s) & ~m.rlike(r"^\d{4}-") & day(*order).isNotNull(), let(day(*order), changed(fmt.format(s))))
    return kinds.otherwise(m)


def iban(m: Column, key: str) -> Column:
    """Account numbers whose check digits are right (modulo 97); country and pattern stay."""
    plain = F.regexp_replace(m, " ", "")
    rest = lambda s: F.aggregate(F.transform(F.split(s, ""), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))), F.lit(0), lambda r, d: F.pmod(F.when(F.length(d) == 2, r * 100).otherwise(r * 10) + d.cast("int"), F.lit(97)))

    def changed(s: Column) -> Column:
        head = F.substring(s, 1, 2)
        build = lambda b: F.concat(head, F.lpad((98 - rest(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), b)
        spaced = lambda t: F.when(m.contains(" "), F.rtrim(F.regexp_replace(t, "(.{4})", "$1 "))).otherwise(t)
        ok = rest(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1
        return F.when(ok, let(let(feistel_text(F.substring(s, F.lit(5), F.length(s)), key + "iban"), build), spaced)).otherwise(m)

    return let(plain, changed)


def tail(prefix: str, kind: str) -> Callable[[Column, str], Column]:
    """Pseudonyms of what follows prefix."""
    return lambda m, key: F.concat(F.regexp_extract(m, prefix, 0), feistel_text(F.regexp_replace(m, prefix, ""), key + kind))


def email(m: Column, key: str) -> Column:
    return F.concat(feistel_text(F.substring_index(m, "@", 1), key + "email"), F.lit("@"), F.substring_index(m, "@", -1))


CHANGES: dict[str, Callable[[Column, str], Column]] = {
    "email": email, "access_key": tail("^AKIA|^ASIA", "access_key"), "password": tail(r"^[A-Za-z_]+[ \t]*=[ \t]*[\"']?", "password"), "iban": iban,
    "date": date, "card": card, "phone": phone, "ssn": ssn, "ipv4": ipv4,
}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a match that fails its format's check stays."""
    whole = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    kinds = None
    for kind, change in CHANGES.items():
        kinds = F.when(whole(kind), change(m, key)) if kinds is None else kinds.when(whole(kind), change(m, key))
    return kinds.otherwise(m)


def pseudonymise(docs: DataFrame, *, key: str, column: str = "text") -> DataFrame:
    """docs with the personal data in column under pseudonyms, and __found: how many were replaced
    (in place of a column of that name).

    Null and empty texts stay as they are; very long ones are searched whole. Nothing is shuffled, so
    order and partitions stay and repeated rows get the same pseudonyms; an empty table stays empty. Where
    formats could begin at the same place the first of PATTERNS wins. Texts without a digit, @ or = are not searched.
    """
    names = [c for c in docs.columns if c != "__found"]
    held = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(column).alias("text"))
    found = F.when(F.col("text").rlike("[0-9@=]"), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    held = held.withColumn("m", F.coalesce(found, F.expr("cast(array() as array<string>)")))
    held = held.withColumn("p", F.when(F.size("m") > 0, F.transform("m", lambda m: pseudonym(m, key))).otherwise(F.col("m")))
    between = F.split(F.col("text"), ANY, -1)
    joined = F.array_join(F.zip_with(between, F.col("p"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("m", "p", lambda a, b: a != b), lambda x: x))
    text = F.when(F.size("m") > 0, joined).otherwise(F.col("text"))
    return held.select(*[(text if c == column else F.col("row")[c]).alias(c) for c in names], changed.alias("__found"))


def op2_pii(spark: SparkSession, sf_dir: str, key: str = "an example key") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key=key).select("doc_id", "text", F.col("__found").alias("n_replaced"))
