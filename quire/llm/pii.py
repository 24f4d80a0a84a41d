"""Format-preserving pseudonyms for validated numbers and dates, in DataFrame functions only.

Each value is moved by a keyed Feistel permutation inside the set of values of its own format: a card stays a card
with a right check digit, an address stays an address, a date stays a date written alike. A permutation sends equal
values to equal pseudonyms and different ones to different ones, so values stay linked across documents.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name

ROUNDS = 8
#: The written forms, in the order in which they are tried at a place of the text. Every part is bounded
#: (a domain as the name system bounds it), so that matching a text of any length takes a bounded stack.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9-]|[./][0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
}
PATTERN = "|".join(FORMS.values())
KINDS = tuple(FORMS)
#: Days from 1900-01-01 to 2099-12-31 are 319 * 229.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1900-01-01", 319, 229


def _long(c: Column | int) -> Column:
    return F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")


def _keyed(key: str, kind: str, step: Column, value: Column, size: Column) -> Column:
    """The round function: a keyed digest of ``value``, below ``size``."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), size.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long"), size)


def feistel(key: str, kind: str, left: Column, left_size: Column | int, right: Column, right_size: Column | int) -> Column:
    """Struct (l, r): the pair moved inside [0, left_size) x [0, right_size), one half by the other in turn."""
    m, n = _long(left_size), _long(right_size)

    def turn(acc: Column, i: Column) -> Column:
        moved_l = F.pmod(acc["l"] + _keyed(key, kind, i, acc["r"], m), m)
        moved_r = F.pmod(acc["r"] + _keyed(key, kind, i, acc["l"], n), n)
        even = i % 2 == 0
        return F.struct(F.when(even, moved_l).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(moved_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), turn)


def _pad(c: Column, n: Column | int) -> Column:
    return F.lpad(c.cast("string"), F.lit(n) if isinstance(n, int) else n, F.lit("0"))


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of up to 36 digits, moved among the strings of that length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    high = F.when(a > 0, F.substring(digits, F.lit(1), a).cast("long")).otherwise(_long(0))
    moved = feistel(key, kind, high, _power(a), F.substring(digits, a + 1, b).cast("long"), _power(b))
    return F.when(n == 0, digits).otherwise(_let(moved, lambda m: F.concat(F.when(a > 0, _pad(m["l"], a)).otherwise(F.lit("")), _pad(m["r"], b))))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def refill(token: Column, digits: Column) -> Column:
    """``token`` with its digits replaced in turn; all else stays."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(acc: Column, ch: Column) -> Column:
        digit = ch.between("0", "9")
        return F.struct(
            F.concat(acc["o"], F.when(digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(ch)).alias("o"),
            F.when(digit, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["o"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string, its last digit standing at the check place."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(key: str, t: Column) -> Column:
    def moved(d: Column) -> Column:
        middle = permute_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2))
        body = F.concat(F.substring(d, 1, 1), middle)
        whole = _let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
        zeros = d.rlike("^0+$")
        return F.when((luhn_sum(d) % 10 == 0) & ~zeros, refill(t, whole)).otherwise(t)

    return _let(_digits(t), moved)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of an account number's letters and digits, the first four at the end."""

    def add(acc: Column, ch: Column) -> Column:
        letter = ch.between("A", "Z")
        return F.when(letter, (acc * 100 + F.ascii(ch) - 55) % 97).otherwise((acc * 10 + F.when(letter, F.lit(0)).otherwise(F.ascii(ch) - 48)) % 97)

    return F.aggregate(F.split(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)), ""), F.lit(0), add)


def _iban(key: str, t: Column) -> Column:
    def moved(s: Column) -> Column:
        rest = F.substring(s, F.lit(5), F.length(s))
        country = F.substring(s, 1, 2)
        body = refill(rest, permute_digits(key, "iban", _digits(rest)))

        def whole(b: Column) -> Column:
            check = _pad(F.lit(98) - _mod97(F.concat(country, F.lit("00"), b)), 2)
            return refill(t, _digits(F.concat(check, b)))

        return F.when(_mod97(s) == 1, _let(body, whole)).otherwise(t)

    return _let(F.regexp_replace(t, " ", ""), moved)


def _ip(key: str, t: Column) -> Column:
    p = F.split(t, r"\.")
    octet = [p[i].cast("long") for i in range(4)]
    moved = feistel(key, "ip", octet[0] * 256 + octet[1], 65536, octet[2] * 256 + octet[3], 65536)
    return _let(moved, lambda m: F.concat_ws(".", F.floor(m["l"] / 256), m["l"] % 256, F.floor(m["r"] / 256), m["r"] % 256))


def _ssn(key: str, t: Column) -> Column:
    area, group, serial = (F.substring(t, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))
    moved = feistel(key, "ssn", place * 99 + group - 1, 898 * 99, serial - 1, 9999)

    def out(m: Column) -> Column:
        x = F.floor(m["l"] / 99)
        return F.concat_ws("-", _pad(x + F.when(x >= 665, F.lit(2)).otherwise(F.lit(1)), 3), _pad(m["l"] % 99 + 1, 2), _pad(m["r"] + 1, 4))

    return F.when(valid, _let(moved, out)).otherwise(t)


def _phone(key: str, t: Column) -> Column:
    def moved(d: Column) -> Column:
        n = F.length(d)
        area, exchange, line = (F.substring(d, n - k, F.lit(m)).cast("long") for k, m in ((9, 3), (6, 3), (3, 4)))
        base_a, size_a = (F.when(area < 200, F.lit(x)).otherwise(F.lit(y)).cast("long") for x, y in ((0, 200), (200, 800)))
        base_e, size_e = (F.when(exchange < 200, F.lit(x)).otherwise(F.lit(y)).cast("long") for x, y in ((0, 200), (200, 800)))
        to = feistel(key, "phone", (area - base_a) * size_e + exchange - base_e, size_a * size_e, line, 10_000)
        number = _let(to, lambda m: F.concat(F.substring(d, F.lit(1), n - 10), _pad(F.floor(m["l"] / size_e) + base_a, 3), _pad(m["l"] % size_e + base_e, 3), _pad(m["r"], 4)))
        return refill(t, number)

    return _let(_digits(t), moved)


def _date(key: str, t: Column) -> Column:
    def written(fmt: str) -> Column:
        day = F.datediff(F.try_to_date(t, fmt), F.lit(FIRST_DAY).cast("date")).cast("long")
        moved = feistel(key, "date", F.floor(day / DAY_LOW), DAY_HIGH, day % DAY_LOW, DAY_LOW)
        return _let(moved, lambda m: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (m["l"] * DAY_LOW + m["r"]).cast("int")), fmt))

    out = F.when(t.contains("-"), written("yyyy-MM-dd")).when(t.contains("/"), _slashed(key, t)).otherwise(written("dd.MM.yyyy"))
    return F.coalesce(out, t)


def _slashed(key: str, t: Column) -> Column:
    """dd/MM/yyyy and MM/dd/yyyy; null where neither reading is a day of the calendar.

    Strings that can be read both ways, those that are only day first and those that are only month first are three
    sets, each moved inside itself; of the latter two, the days up to the 28th, the 29th and 30th, the 31st, and the 29th of
    February are again moved among their like, so that every result is a day and no two values meet.
    """
    first, second, year = (F.substring(t, *x).cast("long") for x in ((1, 2), (4, 2), (7, 4)))
    both = first.between(1, 12) & second.between(1, 12)
    day, month, y = F.greatest(first, second), F.least(first, second), year - 1900
    valid = both | (month >= 1) & (month <= 12) & F.try_to_date(F.concat_ws("-", year.cast("string"), _pad(month, 2), _pad(day, 2)), "yyyy-MM-dd").isNotNull()
    leap, long_month = (day == 29) & (month == 2), F.floor(F.when(month > 7, month).otherwise(month - 1) / 2)

    def by_set(ambiguous, usual, late, last, leap_day) -> Column:
        return F.when(both, _long(ambiguous)).when(day <= 28, _long(usual)).when(leap, _long(leap_day)).when(day <= 30, _long(late)).otherwise(_long(last))

    eleven = month - F.when(month > 2, F.lit(2)).otherwise(F.lit(1))
    leaps = F.floor((year - 1904) / 4)
    left = by_set(y * 12 + first - 1, y * 12 + month - 1, y * 11 + eleven, y, F.floor(leaps / 7))
    right = by_set(second - 1, day - 13, day - 29, long_month, leaps % 7)
    moved = feistel(key, "slashed", left, by_set(2400, 2400, 2200, 200, 7), right, by_set(12, 16, 2, 7, 7))

    def out(m: Column) -> Column:
        to = m["l"] % 11
        to_month = by_set(0, m["l"] % 12 + 1, to + F.when(to > 0, F.lit(2)).otherwise(F.lit(1)), F.when(m["r"] > 3, m["r"] * 2).otherwise(m["r"] * 2 + 1), 2)
        to_day = by_set(0, m["r"] + 13, m["r"] + 29, 31, 29)
        to_year = by_set(F.floor(m["l"] / 12) + 1900, F.floor(m["l"] / 12) + 1900, F.floor(m["l"] / 11) + 1900, m["l"] + 1900, (m["l"] * 7 + m["r"]) * 4 + 1904)
        day_first = first > 12
        a = F.when(both, m["l"] % 12 + 1).when(day_first, to_day).otherwise(to_month)
        b = F.when(both, m["r"] + 1).when(day_first, to_month).otherwise(to_day)
        return F.concat_ws("/", _pad(a, 2), _pad(b, 2), to_year.cast("string"))

    return F.when(valid, _let(moved, out))


def _email(key: str, t: Column) -> Column:
    """The part before the sign: letters move among letters and digits among digits, half by half."""
    local = F.substring_index(t, "@", 1)
    h = F.floor(F.length(local) / 2).cast("int")

    def shifted(part: Column, by: Column, i: Column) -> Column:
        def one(ch: Column, j: Column) -> Column:
            step = _keyed(key, "email", F.concat_ws(",", i.cast("string"), j.cast("string")), by, _long(260))
            code = F.ascii(ch)
            return (
                F.when(ch.between("a", "z"), F.chr(F.pmod(code - 97 + step, F.lit(26)) + 97))
                .when(ch.between("A", "Z"), F.chr(F.pmod(code - 65 + step, F.lit(26)) + 65))
                .when(ch.between("0", "9"), F.chr(F.pmod(code - 48 + step, F.lit(10)) + 48))
                .otherwise(ch)
            )

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i)).alias("r"))

    start = F.struct(F.substring(local, F.lit(1), h).alias("l"), F.substring(local, h + 1, F.length(local)).alias("r"))
    moved = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.concat(moved, F.substring(t, F.length(local) + 1, F.length(t)))


_MOVE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(t: Column) -> Column:
    """The first written form that the whole token has."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(t.rlike(rf"^(?:{FORMS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(t: Column, key: str) -> Column:
    """A token moved by its kind; unchanged where it fails its kind's validation (check digit, ranges, calendar)."""

    def by_kind(kind: Column) -> Column:
        out = t
        for k in KINDS:
            out = F.when(kind == k, _MOVE[k](key, t)).otherwise(out)
        return out

    return _let(kind_of(t), by_kind)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None, changed: str | None = None) -> DataFrame:
    """``docs`` with the personal numbers and dates of ``text`` replaced by pseudonyms; other columns stay as they are.

    Row by row, with no shuffle and no Python. ``found`` and ``changed`` name optional columns with the number of
    tokens that have a known form and of those that were replaced. Null text stays null (counts 0), empty text empty.
    Equal rows give equal rows; an empty table gives an empty one. A token whose form matches but whose check fails
    is left as it stands, as is an address whose domain has more labels or longer ones than the name system allows. A
    date is linked with dates written alike. Texts may have any length; columns of the input keep their names.
    """
    key = hashlib.sha256(key.encode()).hexdigest()  # the plan does not show the key itself
    source = F.col(f"`{text}`").cast("string")
    tokens = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)))
    some = F.size(tokens) > 0

    def rebuilt(pair: Column) -> Column:
        parts = F.zip_with(F.split(source, PATTERN, -1), F.concat(pair["new"], F.array(F.lit(""))), lambda g, t: F.concat(g, t))
        return F.array_join(parts, "")

    pairs = F.when(some, F.struct(tokens.alias("old"), F.transform(tokens, lambda t: pseudonym(t, key)).alias("new")))
    pair = free_name([*docs.columns, *(n for n in (found, changed) if n)], "tokens")
    out = docs.withColumn(pair, pairs)
    p = F.col(pair)
    out = out.withColumn(text, F.when(p.isNull(), source).otherwise(rebuilt(p)))
    if found:
        out = out.withColumn(found, F.coalesce(F.size(p["old"]), F.lit(0)).cast("long"))
    if changed:
        moved = F.aggregate(F.zip_with(p["old"], p["new"], lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
        out = out.withColumn(changed, F.coalesce(moved, F.lit(0)).cast("long"))
    return out.drop(pair)
