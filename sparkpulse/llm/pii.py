"""Format-preserving pseudonyms, in DataFrame functions only.

Found values are validated and permuted within their format by a keyed Feistel network, so equal values stay equal across
documents and stay valid: payment-card numbers (13 to 19 digits, Luhn; the check digit is worked out anew), dates
(year-month-day, month/day/year, day.month.year; 1800 to 2199), US social security numbers, IPv4 addresses and phone
numbers with a country code (the code stays).  Values that follow one another are told apart: a run of digit groups is searched for
cards by Luhn and grouping, and a phone number ends before an address or date.  The network adds round values modulo the two factors of the format's size,
hence it permutes exactly the format's values and no cycle-walking is needed.  E-mail addresses and 40-digit hexadecimal
secrets get keyed hash pseudonyms of their form.  Digits that don't validate stay as they are.

A slashed date that is valid only as day/month/year keeps that order.  Null texts stay null, texts without values stay as
they are byte for byte, repeated rows get equal texts and other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bind

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![/-]|\.\d|(?!T\d{2}(?!\w)|T\d{2}:?\d{2})\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
#: North American numbers; then numbers with a bracketed area code and dashes; then any groups, but not the start of an address or a date.
PHONE = r"(?<![\w+])\+(?:1[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}(?!\w)|\d{1,3}[ -]?\(\d{2,4}\)[ -]?\d{2,4}(?:-\d{2,4}){1,2}(?!\w|-\d)|\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}(?!\w|[./-]\d))"
#: A run of groups of digits (13 digits at least) up to the next date, number or address of another kind; cards are looked for within it.
GROUP = r"\d++(?!\w|-(?!\d))"
CARD = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!{DATE}|{SSN}|{IP}){GROUP})*+"
SECRET = r"(?<!\w)[0-9a-fA-F]{40}(?!\w)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, DATE, SSN, IP, PHONE, CARD, SECRET))
#: Cards are written in one group or in these; other groupings count where none of these is.
CARD_SHAPES = ("4-4-4-4", "4-4-4-4-3", "4-6-5", "4-6-4", "4-4-4-1", "4-4-5")
#: Country codes of two digits; 1 and 7 are whole codes, all others have three.
CODES = r"^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: 1800-01-01 as a day number, and the days of a Gregorian cycle of 400 years, which are 189 * 773.
EPOCH, DAYS = -62091, (189, 773)
SSN_SIZES = (898 * 99, 9999)


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def feistel(x: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A permutation of {0 .. a*b - 1} for each key and tweak."""

    def value(half: Column, i: Column, size: Column) -> Column:
        return F.conv(F.substring(keyed(key, tweak, i.cast("string"), half.cast("string")), 1, 15), 16, 10).cast("long") % size

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (s["l"] + value(s["r"], i, s["a"])) % s["a"]).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + value(s["l"], i, s["b"])) % s["b"])
        return F.struct(left.alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    a, b = a.cast("long"), b.cast("long")
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * s["b"] + s["r"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def refill(m: Column, new: Column) -> Column:
    """m with its digits replaced in turn by those of new."""
    chars = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)).rlike(r"\d"), F.substring(new, F.length(digits(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(F.substring(m, i, F.lit(1))))
    return F.array_join(chars, "")


def permuted_digits(d: Column, key: str, kind: str) -> Column:
    """As many digits as d, at most 18, permuted."""
    n = F.length(d)
    a, b = F.rpad(F.lit("1"), 1 + F.floor(n / 2).cast("int"), "0"), F.rpad(F.lit("1"), 1 + F.ceil(n / 2).cast("int"), "0")
    return F.lpad(feistel(d.cast("long"), a, b, key, F.concat(F.lit(kind), n.cast("string"))).cast("string"), n, "0")


def luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits before the check digit."""
    n = F.length(payload)

    def one(i: Column) -> Column:
        x = F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + one(i))


def check_digit(payload: Column) -> Column:
    return ((10 - luhn_sum(payload) % 10) % 10).cast("string")


def card(m: Column, key: str) -> Column:
    """m, a card number, replaced."""
    d = digits(m)
    return refill(m, bind(permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda x: F.concat(x, check_digit(x))))


def cards(m: Column, key: str) -> Column:
    """(new, n): m, a run of groups of digits, with its card numbers replaced, and their number."""
    groups, marks = F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), F.split(m, r"\d+", -1)
    parts = F.zip_with(groups, F.slice(marks, 2, F.size(groups)), lambda g, s: F.struct(g.alias("g"), s.alias("s")))

    def luhn(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return F.length(d).between(13, 19) & (F.substring(d, F.length(d), F.lit(1)) == check_digit(body))

    def size(ps: Column, i: Column, usual: bool) -> Column:
        """How many groups from i on are a card, 0 without one: the least of the usual shapes, or else the most."""

        def is_card(k: Column) -> Column:
            own = F.slice(ps, i + 1, k)
            whole = luhn(F.array_join(F.transform(own, lambda p: p["g"]), ""))
            shape = F.array_join(F.transform(own, lambda p: F.length(p["g"]).cast("string")), "-")
            return ((k == 1) | shape.isin(*CARD_SHAPES)) & whole if usual else whole

        sizes = F.sequence(F.lit(1), F.least(F.lit(5 if usual else 19), F.size(ps) - i))
        return F.coalesce((F.array_min if usual else F.array_max)(F.filter(sizes, is_card)), F.lit(0))

    def scan(s: Column) -> Column:
        ps, usual = s["ps"], s["usual"]

        def step(a: Column, i: Column) -> Column:
            def add(k: Column) -> Column:
                own = F.slice(ps, i + 1, F.greatest(k, F.lit(1)))
                text = F.array_join(F.transform(own, lambda p, q: F.when(q < F.size(own) - 1, F.concat(p["g"], p["s"])).otherwise(p["g"])), "")
                new = F.concat(F.when(k > 0, card(text, key)).otherwise(text), F.element_at(own, -1)["s"])
                return F.struct(F.concat(a["out"], F.array(new)).alias("out"), (i + F.greatest(k, F.lit(1))).alias("next"), (a["n"] + (k > 0).cast("int")).alias("n"))

            u = F.get(usual, i)
            other = bind(size(ps, i, False), lambda k: F.when(F.exists(F.slice(usual, i + 1, k), lambda v: v > 0), F.lit(0)).otherwise(k))
            return F.when(i < a["next"], a).otherwise(bind(F.when(u > 0, u).otherwise(other), add))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), start, step, lambda a: F.struct(F.array_join(a["out"], "").alias("new"), a["n"].alias("n")))

    both = bind(parts, lambda ps: F.struct(ps.alias("ps"), F.transform(ps, lambda p, i: size(ps, i, True)).alias("usual")))
    return bind(both, scan)


def date(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, r"[-/.]"), F.lit(i)).cast("int")

    def day(y: int, mo: int, d: int) -> Column:
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part(y), part(mo), part(d)), F.lit("yyyy-MM-dd")).cast("date")

    def moved(x: Column, form: str) -> Column:
        n = F.unix_date(x) - EPOCH
        inside = (n >= 0) & (n < DAYS[0] * DAYS[1])
        new = feistel(n.cast("long"), F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"))
        return F.when(x.isNotNull() & inside, F.date_format(F.date_from_unix_date((new + EPOCH).cast("int")), form))

    iso = F.when(m.contains("-"), moved(day(0, 1, 2), "yyyy-MM-dd"))
    dotted = F.when(m.contains("."), moved(day(2, 1, 0), "dd.MM.yyyy"))
    slashed = F.when(m.contains("/"), F.coalesce(moved(day(2, 0, 1), "MM/dd/yyyy"), moved(day(2, 1, 0), "dd/MM/yyyy")))
    return F.coalesce(iso, dotted, slashed, m)


def ssn(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("long")
    area, group, serial = part(0), part(1), part(2)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    x = feistel((rank * 99 + group - 1) * 9999 + serial - 1, F.lit(SSN_SIZES[0]), F.lit(SSN_SIZES[1]), key, F.lit("ssn"))

    def form(v: Column) -> Column:
        r = F.floor(v / (99 * 9999))
        return F.format_string("%03d-%02d-%04d", F.when(r >= 665, r + 2).otherwise(r + 1), F.floor(v / 9999) % 99 + 1, v % 9999 + 1)

    return F.when(valid, bind(x, form)).otherwise(m)


def ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(part, lambda x: x < 256)
    x = feistel(F.aggregate(part, F.lit(0).cast("long"), lambda s, v: s * 256 + v), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    octets = lambda v: F.concat_ws(".", *(F.floor(v / 256**k).cast("long") % 256 for k in (3, 2, 1, 0)))
    return F.when(valid, bind(x, octets)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    d = digits(m)
    kept = F.when(d.rlike("^[17]"), 1).when(d.rlike(CODES), 2).otherwise(3)
    return refill(m, F.concat(F.substring(d, F.lit(1), kept), permuted_digits(F.substring(d, kept + 1, F.lit(18)), key, "phone")))


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("p"), F.substring(keyed(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@example.invalid"))


def secret(m: Column, key: str) -> Column:
    h = F.substring(keyed(key, F.lit("secret"), F.lower(m)), 1, 40)
    return F.when(m.rlike("[A-F]"), F.upper(h)).otherwise(h)


def pseudonym(m: Column, key: str) -> Column:
    """(new, n): the pseudonym of m, and how many values were replaced."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    one = lambda x: bind(x, lambda y: F.struct(y.alias("new"), (y != m).cast("int").alias("n")))
    out = F.when(m.contains("@"), one(email(m, key))).when(whole(r"[0-9a-fA-F]{40}"), one(secret(m, key))).when(m.startswith("+"), one(phone(m, key)))
    out = out.when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4}"), one(date(m, key))).when(whole(r"\d{3}-\d{2}-\d{4}"), one(ssn(m, key)))
    return out.when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), one(ip(m, key))).otherwise(cards(m, key))


def pseudonymise(docs: DataFrame, *, key: str = "sparkpulse", text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the found values of ``text`` replaced; count: the name of a column with the number of replaced values."""
    t = F.col(text)
    found = bind(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda xs: F.transform(xs, lambda m: pseudonym(m, key)))
    some = t.rlike("[0-9@]|[0-9a-fA-F]{40}")
    both = F.when(some, F.struct(F.split(t, ANY, -1).alias("between"), found.alias("found")))
    d = docs.withColumn("__pii", both)
    p = F.col("__pii")
    pieces = F.zip_with(p["between"], p["found"], lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit(""))))
    new = F.when(p.isNull() | (F.size(p["found"]) == 0), t).otherwise(F.array_join(pieces, ""))
    out = d.withColumn(text, new)
    if count:
        out = out.withColumn(count, F.coalesce(F.aggregate(p["found"], F.lit(0), lambda n, x: n + x["n"]), F.lit(0)).cast("long"))
    return out.drop("__pii")
