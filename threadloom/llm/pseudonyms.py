"""Personal data replaced by format-preserving pseudonyms.

Numbers, dates and addresses are found and validated; each is permuted within its own format
by a keyed Feistel network, so that a value has the same pseudonym in every document, two
values never share one, and the form stays: length, separators, check digit, calendar.

* card: 13 to 19 digits passing the Luhn check; all but the check digit are permuted and the
  check digit is renewed. Digit runs of 9 or more failing it are ``number``: all permuted,
  long ones in pieces of 9 to 18 digits.
* iban: the digits behind the check digits are permuted, those are renewed (mod 97), in either
  case. One that fails the check is a number if it has 9 digits or more, else it stays.
* phone: the last ten digits are permuted, the country code stays; of other numbers behind a plus
  sign and a country code of their own, all digits behind that.
* ssn: nine digits in the usual grouping. * ip: four octets, permuted as one 32-bit number.
* date: days of the years 1800 to 2199, as yyyy-MM-dd (also before a time), yyyy/MM/dd, dd.MM.yyyy,
  MM/dd/yyyy, or dd/MM/yyyy where MM/dd is no date, and dd-MM-yyyy, or MM-dd-yyyy where dd-MM is none, the
  latter four with one-digit days and months too. Days up to the 12th are permuted among themselves, and so
  are later ones: what is read one way only stays so. One day has one pseudonym in all these
  spellings, each keeps its own. M/d/yy is permuted within a century.
  Other dates do not exist: kept, not counted. Dates with month names are not found.
* email: letters and digits of the local part move within their class; the domain stays.

Null texts stay null; empty texts, texts without finds and all other columns stay as they
are; an empty table gives an empty one. The columns ``n_<kind>`` are replaced if present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: kind: pattern of the whole value. Matching tries them in this order.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
            r"|[a-z]{2}\d{2}(?:[a-z0-9]{11,30}|(?: \d{4}){2,7}(?: \d{1,3})?))(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w.]*\w)",
    "date": r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d)|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}"
            r"|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}-\d{1,2}-\d{4})(?!\w))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]*\w)",
    "phone": r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "abroad": r"(?<!\w)\+\d{1,3}(?=(?:\D?\d){6,14}(?!\D?\d))(?:[ .-]\(?\d{1,8}\)?){1,6}(?!\w)",
    # up to 19 digits unless fewer than nine would be left behind them, else the whole run
    "number": r"(?<!\w)\d(?:(?:[ -]?\d){8,18}(?!\w)(?:(?![ -]\d)|(?=[ -]\d(?:[ -]?\d){8}))|(?:[ -]?\d){8}[\d -]*(?<=\d)(?!\w))",
}
COUNTED = ("email", "ip", "date", "ssn", "phone", "card", "iban", "number")
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 8
#: The first year of dates and the months from there; the months of a century for years of two digits.
FIRST_YEAR, MONTHS, CENTURY = 1800, 4800, 1200
#: Steps until a day of a month is drawn that has it. One in thirty draws has not.
WALK = 60


def _prf(key: Column, label: str, turn: Column | int, value: Column, modulus: Column) -> Column:
    """A keyed number below ``modulus`` from 60 bits of SHA-256."""
    turn = turn if isinstance(turn, Column) else F.lit(turn)
    digest = F.sha2(F.concat_ws("|", key, F.lit(label), turn.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, key: Column, label: str) -> Column:
    """Permutes (high, low) within high_size x low_size; returns struct(high, low)."""
    def step(x: Column, turn: Column) -> Column:
        new_high = F.pmod(x["high"] + _prf(key, label + "h", turn, x["low"], high_size), high_size)
        return let(new_high, lambda h: F.struct(
            h.alias("high"), F.pmod(x["low"] + _prf(key, label + "l", turn, h, low_size), low_size).alias("low"),
        ))

    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))
    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), start, step)


def _digits_permuted(digits: Column, key: Column, label: str) -> Column:
    """A digit string of 2 to 20 digits permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    sized = F.struct(
        F.substring(digits, F.lit(1), left).cast("long").alias("high"),
        F.substring(digits, left + 1, n).cast("long").alias("low"),
        F.rpad(F.lit("1"), left + 1, "0").cast("long").alias("high_size"),
        F.rpad(F.lit("1"), n - left + 1, "0").cast("long").alias("low_size"),
        left.alias("left"), n.alias("n"),
    )
    return let(sized, lambda s: let(
        feistel(s["high"], s["low"], s["high_size"], s["low_size"], key, label),
        lambda x: F.concat(
            F.lpad(x["high"].cast("string"), s["left"], "0"), F.lpad(x["low"].cast("string"), s["n"] - s["left"], "0")
        ),
    ))


def _number(digits: Column, key: Column) -> Column:
    """A digit string of any length permuted, above 19 digits in pieces."""
    n = F.length(digits)
    many = F.ceil(n / 18).cast("int")

    def piece(i: Column) -> Column:
        start, stop = F.floor(i * n / many).cast("int"), F.floor((i + 1) * n / many).cast("int")
        own = F.concat_ws("|", key, n.cast("string"), i.cast("string"))
        return _digits_permuted(F.substring(digits, start + 1, stop - start), own, "number")

    pieces = F.array_join(F.transform(F.sequence(F.lit(0), many - 1), piece), "")
    return F.when(n > 19, pieces).otherwise(_digits_permuted(digits, key, "number"))


def _mod97(text: Column) -> Column:
    """Letters and digits as a decimal number, A being 10, modulo 97."""
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _is_iban(value: Column) -> Column:
    plain = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    return value.rlike(f"^(?:{KINDS['iban']})$") & F.length(plain).between(15, 34) & (_mod97(moved) == 1)


def _iban(value: Column, digits: Column, key: Column) -> Column:
    country = F.upper(F.substring(value, 1, 2))

    def checked(body: Column) -> Column:
        plain = F.upper(F.replace(_refilled(value, F.concat(F.lit("00"), body)), F.lit(" "), F.lit("")))
        check = F.lpad((98 - _mod97(F.concat(F.substring(plain, 5, 34), country, F.lit("00")))).cast("string"), 2, "0")
        return _refilled(value, F.concat(check, body))

    body = F.substring(digits, F.lit(3), F.length(digits))
    return let(F.when(F.length(body) > 1, _number(body, F.concat(key, F.lit("|iban")))).otherwise(body), checked)


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """The Luhn sum; ``doubled_first`` says whether the first digit counts double."""
    def worth(d: Column, i: Column) -> Column:
        twice = ((i % 2 == 0) & doubled_first) | ((i % 2 == 1) & ~doubled_first)
        v = d.cast("int")
        return F.when(twice, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, b: a + b)


def _is_card(digits: Column) -> Column:
    n = F.length(digits)
    return n.between(13, 19) & (luhn_sum(digits, n % 2 == 0) % 10 == 0)


def _card(digits: Column, key: Column) -> Column:
    n = F.length(digits)
    return let(
        _digits_permuted(F.substring(digits, F.lit(1), n - 1), key, "card"),
        lambda body: F.concat(body, F.pmod(-luhn_sum(body, n % 2 == 0), F.lit(10)).cast("string")),
    )


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, in order, replaced by ``digits``."""
    return F.array_join(
        F.zip_with(F.split(shape, r"\d", -1), F.split(digits, ""), lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))), ""
    )


def _day_moved(date: Column, first_year: Column, months: Column, key: Column) -> Column:
    """A day permuted among the days up to the 12th of its span of years, or among the others."""
    early = F.day(date) <= 12
    days = F.when(early, 12).otherwise(19).cast("long")
    before = F.when(early, 1).otherwise(13)

    def first_of(x: Column) -> Column:
        return F.make_date((first_year + F.floor(x["high"] / 12)).cast("int"), (x["high"] % 12 + 1).cast("int"), F.lit(1))

    def step(x: Column) -> Column:
        own = F.concat(key, F.when(early, "|early").otherwise("|late"), months.cast("string"))
        return feistel(x["high"], x["low"], months, days, own, "date")

    start = F.struct(((F.year(date) - first_year) * 12 + F.month(date) - 1).alias("high"), (F.day(date) - before).alias("low"))
    there = lambda x: x["low"] + before <= F.day(F.last_day(first_of(x)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), let(start, step), lambda x, _: F.when(there(x), x).otherwise(step(x)))
    return let(walked, lambda x: F.date_add(first_of(x), (x["low"] + before - 1).cast("int")))


def _date(value: Column, key: Column) -> Column:
    """Dates in their spelling; null for what is no day of the range."""
    fields = F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
    at = lambda f, i: F.element_at(f, i)
    year_first = value.rlike(r"^\d{4}")
    short = value.rlike(r"/\d\d$") & ~year_first
    padded = value.rlike(r"^\d\d[./-]\d\d[./-]")

    def made(f: Column) -> Column:
        year = F.when(year_first, at(f, 1)).when(short, F.concat(F.lit("20"), at(f, 3))).otherwise(at(f, 3))
        day_of = lambda month, day: F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")
        month_first, day_first = day_of(at(f, 1), at(f, 2)), day_of(at(f, 2), at(f, 1))
        read = F.when(year_first, F.struct(day_of(at(f, 2), at(f, 3)).alias("date"), F.lit(False).alias("month_first")))
        american = F.struct(month_first.alias("date"), F.lit(True).alias("month_first"))
        other = F.struct(day_first.alias("date"), F.lit(False).alias("month_first"))
        read = read.when(value.contains("."), other).when(value.contains("/"), F.when(month_first.isNotNull(), american).otherwise(other))
        return let(read.otherwise(F.when(day_first.isNotNull(), other).otherwise(american)), moved)

    def moved(r: Column) -> Column:
        first_year = F.when(short, 2000).otherwise(FIRST_YEAR)
        months = F.when(short, CENTURY).otherwise(MONTHS).cast("long")
        inside = r["date"].isNotNull() & F.year(r["date"]).between(first_year, first_year + months / 12 - 1)
        return F.when(inside, let(_day_moved(r["date"], first_year, months, key), lambda new: spelt(new, r["month_first"])))

    def spelt(new: Column, month_first: Column) -> Column:
        sign = F.regexp_extract(value, r"\D", 0)
        two = lambda n: F.when(padded | year_first, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        year = F.lpad(F.when(short, F.year(new) % 100).otherwise(F.year(new)).cast("string"), F.when(short, 2).otherwise(4), "0")
        month, day = two(F.month(new)), two(F.day(new))
        parts = F.when(year_first, F.concat_ws("-", year, month, day)).when(
            month_first, F.concat_ws("-", month, day, year)).otherwise(F.concat_ws("-", day, month, year))
        return F.replace(parts, F.lit("-"), sign)

    return let(fields, made)


def _ip(value: Column, key: Column) -> Column:
    octets = F.split(value, r"\.")
    at = lambda i: F.element_at(octets, i).cast("long")
    half = F.lit(65536).cast("long")
    return let(
        feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), half, half, key, "ip"),
        lambda x: F.concat_ws(".", *(
            part.cast("long").cast("string") for side in ("high", "low")
            for part in (F.floor(x[side] / 256), x[side] % 256)
        )),
    )


def _email(value: Column, key: Column) -> Column:
    """Two Feistel rounds over the halves of the local part, letter by letter."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    def shifted(half: Column, other: Column, turn: str) -> Column:
        stream = F.sha2(F.concat_ws("|", key, F.lit("email" + turn), F.length(half).cast("string"), domain, other), 256)

        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(stream, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            for first, size in ((97, 26), (65, 26), (48, 10)):
                c = F.when(code.between(first, first + size - 1), F.char(first + (code - first + by) % size)).otherwise(c)
            return c

        return F.array_join(F.transform(F.split(half, ""), move), "")

    cut = F.ceil(F.length(local) / 2).cast("int")
    left, right = F.substring(local, F.lit(1), cut), F.substring(local, cut + 1, F.length(local))
    return let(shifted(left, right, "1"), lambda l: let(
        shifted(right, l, "2"), lambda r: F.concat(shifted(l, r, "3"), r, F.lit("@"), domain)
    ))


def _abroad(value: Column, digits: Column, key: Column) -> Column:
    """A number behind a plus sign and a country code, which stays."""
    code = F.regexp_extract(value, r"^\+(\d+)", 1)
    body = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _refilled(value, F.concat(code, _digits_permuted(body, F.concat(key, F.lit("|"), code), "abroad")))


def kind_of(value: Column, digits: Column) -> Column:
    return (
        F.when(value.contains("@"), "email").when(_is_iban(value), "iban").when(value.rlike(f"^(?:{KINDS['ip']})$"), "ip")
        .when(value.rlike(f"^(?:{KINDS['date']})$"), "date").when(value.rlike(f"^(?:{KINDS['ssn']})$"), "ssn")
        .when(value.rlike(f"^(?:{KINDS['phone']})$"), "phone").when(value.startswith("+"), "abroad").when(value.rlike("^[0-9]") & _is_card(digits), "card")
        .when(value.rlike("^[0-9]") | (F.length(digits) >= 9), "number")
    )


def pseudonym(value: Column, key: Column) -> Column:
    """struct(kind, value): what was found and what replaces it; no kind where the value stays."""
    def made(digits: Column) -> Column:
        phone = F.concat(
            F.substring(digits, F.lit(1), F.length(digits) - 10),
            _digits_permuted(F.substring(digits, F.length(digits) - 9, F.lit(10)), key, "phone"),
        )
        return let(kind_of(value, digits), lambda kind: let(
            F.when(kind == "email", _email(value, key)).when(kind == "ip", _ip(value, key))
            .when(kind == "date", _date(value, key)).when(kind == "phone", _refilled(value, phone))
            .when(kind == "abroad", _abroad(value, digits, key)).when(kind == "ssn", _refilled(value, _digits_permuted(digits, key, "ssn")))
            .when(kind == "card", _refilled(value, _card(digits, key))).when(kind == "iban", _iban(value, digits, key))
            .when(kind == "number", _refilled(value, _number(digits, key))),
            lambda new: F.struct(F.when(new.isNotNull(), F.replace(kind, F.lit("abroad"), F.lit("phone"))).alias("kind"), F.coalesce(new, value).alias("value")),
        ))

    return let(F.regexp_replace(value, r"\D", ""), made)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the finds of ``text`` replaced, and ``n_<kind>`` for every kind.

    ``key`` is the secret of the permutation: keep it out of the data.
    """
    text = F.col("text")
    maybe = text.contains("@") | text.rlike("[0-9]")
    found = F.when(maybe, F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: pseudonym(v, F.lit(key))
    ))
    kept = docs.drop(*(f"n_{k}" for k in COUNTED))
    own = fresh(docs, "found")
    out = kept.withColumn(own, found)
    joined = F.array_join(F.zip_with(
        F.split(text, ANY, -1), own, lambda gap, f: F.concat(gap, F.coalesce(f["value"], F.lit("")))
    ), "")
    some = F.coalesce(F.size(own), F.lit(0)) > 0
    count = lambda k: F.size(F.filter(own, lambda f: f["kind"] == k))
    return out.withColumns({
        **{f"n_{k}": F.when(some, count(k)).otherwise(0).cast("long") for k in COUNTED},
        "text": F.when(some, joined).otherwise(text),
    }).drop(own)
