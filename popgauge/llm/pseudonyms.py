"""Format-preserving pseudonyms for personal data: keyed Feistel permutations in native expressions.

A candidate found by its form is validated (check digit, octets, calendar, number ranges), read as a row of digits of
mixed radix, permuted by an alternating Feistel network whose round function is a keyed SHA-256, and written back
into its own layout. The permutation depends on the value's digits only, not on its separators or document, so equal
values keep equal pseudonyms everywhere and different values different ones. What does not validate stays as it is.

    payment card     Luhn-valid, 13 to 19 digits: all but the check digit are permuted, which is computed anew
    telephone        7 to 15 digits: the last ten (or all) are permuted, a country code stays
    IPv4 address     four octets
    US social number area, group and serial within their valid ranges
    date             ISO, or with slashes year or day first: a day within 1800-2199; with slashes month first where it
                     is no date with the day first: permuted among the dates that only this layout can write
    e-mail           letters and digits of the local part, each within its kind; the domain stays
    hexadecimal key  32 to 64 digits, permuted as hexadecimal in their case; with both cases, each within its kind

Defined results: NULL texts stay NULL, texts without a valid value stay byte for byte; a value that repeats is
replaced each time; NULL ids, repeated rows and empty tables need no care, as every row stands alone; other columns
pass through (``pseudonymised``) or are ignored (``with_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Hexadecimal digits of keyed hash for one element of a half, and elements that three hashes serve.
STEP, SERVED = 6, 32

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}+"
HEX = r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[/-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,3}"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]|[.-][0-9])")
CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
        r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])")
ANY = "|".join((EMAIL, HEX, IP, DATE, SOCIAL, PHONE, CARD))

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Proleptic Gregorian days of 400 years, 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Of these, the days after the twelfth of a month, 9 * 9833, and their mean number in a month.
LATE_DAYS, LATE_MEAN = (9, 9833), 88_497 / 4_800


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def feistel(values: Column, moduli: Column, tweak: str, key: str) -> Column:
    """Keyed permutation of ``values`` (array<bigint>), element i staying within ``[0, moduli[i])``."""
    half = F.floor(F.size(values) / 2).cast("int")
    empty = F.expr("CAST(array() AS array<bigint>)")

    def side(column: Column, first: bool) -> Column:
        start, length = (F.lit(1), half) if first else (half + 1, F.size(column) - half)
        return F.when(length > 0, F.slice(column, start, F.greatest(length, F.lit(1)))).otherwise(empty)

    def shifted(mine: Column, bases: Column, other: Column, number: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(tweak), F.size(values).cast("string"), number.cast("string"), F.array_join(other.cast("array<string>"), ","))
        digest = F.concat(*[F.sha2(F.concat(said, F.lit(f"|{i}")), 256) for i in range(STEP * SERVED // 64)])
        return _let(digest, lambda d: F.zip_with(
            F.transform(mine, lambda v, i: v + F.conv(F.substring(d, i * STEP + 1, F.lit(STEP)), 16, 10).cast("bigint")), bases, lambda v, m: v % m))

    start = F.struct(side(values, True).alias("l"), side(values, False).alias("r"))
    left, right = side(moduli, True), side(moduli, False)
    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
        lambda acc, n: F.when(n % 2 == 0, F.struct(shifted(acc["l"], left, acc["r"], n).alias("l"), acc["r"].alias("r")))
        .otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], right, acc["l"], n).alias("r"))),
    )
    return _let(done, lambda d: F.concat(d["l"], d["r"]))


def _numbers(text: Column) -> Column:
    """Digits of a string as array<bigint>."""
    return F.transform(F.array_remove(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), ""), lambda c: c.cast("bigint"))


def _same(values: Column, modulus: int) -> Column:
    return F.transform(values, lambda _: F.lit(modulus).cast("bigint"))


def _joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "")


def refill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced, in order, by the given ones."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(
        F.split(layout, ""), zero,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(acc["out"], F.substring(digits, acc["k"] + 1, F.lit(1))).alias("out"), (acc["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))),
        lambda acc: acc["out"],
    )


def luhn_digit(payload: Column) -> Column:
    """Check digit of the digits before it."""
    size = F.size(payload)
    terms = F.transform(payload, lambda v, i: F.when((size - i) % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    total = F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return (F.lit(10) - total % 10) % 10


def _card(found: Column, key: str) -> Column:
    def write(digits: Column) -> Column:
        payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
        valid = (luhn_digit(payload) == F.element_at(digits, -1)) & (F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, b: a + b) > 0)
        new = _let(feistel(payload, _same(payload, 10), "card", key), lambda p: F.concat(p, F.array(luhn_digit(p))))
        return F.when(valid, refill(found, _joined(new))).otherwise(found)
    return _let(_numbers(found), write)


def _phone(found: Column, key: str) -> Column:
    def write(digits: Column) -> Column:
        size = F.size(digits)
        stays = F.greatest(size - 10, F.lit(0))
        tail = F.slice(digits, stays + 1, F.least(size, F.lit(10)))
        head = F.substring(_joined(digits), F.lit(1), stays)
        return F.when(size.between(7, 15), refill(found, F.concat(head, _joined(feistel(tail, _same(tail, 10), "phone", key))))).otherwise(found)
    return _let(_numbers(found), write)


def _ip(found: Column, key: str) -> Column:
    octets = F.transform(F.split(found, r"\."), lambda c: c.cast("bigint"))
    return _let(octets, lambda o: F.when(
        F.forall(o, lambda v: v < 256), F.array_join(feistel(o, _same(o, 256), "ip", key).cast("array<string>"), ".")).otherwise(found))


def _social(found: Column, key: str) -> Column:
    area, group, serial = (F.split(found, "-")[i].cast("bigint") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(F.array(index, group - 1, serial - 1), F.array(*[F.lit(m).cast("bigint") for m in (898, 99, 9999)]), "social", key)

    def write(n: Column) -> Column:
        new_area = F.when(n[0] > 664, n[0] + 2).otherwise(n[0] + 1)
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((n[1] + 1).cast("string"), 2, "0"), F.lpad((n[2] + 1).cast("string"), 4, "0"))
    return F.when(valid, _let(new, write)).otherwise(found)


def _date(found: Column, key: str) -> Column:
    iso, slashes = found.contains("-"), found.rlike("^[0-9]{4}/")
    parts = F.split(found, "[/-]")
    year = F.when(iso | slashes, parts[0]).otherwise(parts[2])
    month, day = parts[1], F.when(iso | slashes, parts[2]).otherwise(parts[0])
    stamp = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    number = F.date_diff(stamp, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    one, two = DAYS
    new = feistel(F.array(F.floor(number / two), number % two), F.array(F.lit(one).cast("bigint"), F.lit(two).cast("bigint")), "date", key)

    def write(n: Column) -> Column:
        value = F.date_add(F.lit(FIRST_DAY).cast("date"), (n[0] * two + n[1]).cast("int"))
        return F.when(iso, F.date_format(value, "yyyy-MM-dd")).when(slashes, F.date_format(value, "yyyy/MM/dd")).otherwise(F.date_format(value, "dd/MM/yyyy"))
    return F.when(number.between(0, one * two - 1), _let(new, write)).when(~iso & ~slashes, _month_first(found, key)).otherwise(found)


def _month_first(found: Column, key: str) -> Column:
    """MM/dd/yyyy of a day after the twelfth, permuted among such days; other texts stay."""
    first = F.lit(FIRST_DAY).cast("date")
    parts = F.split(found, "/")
    stamp = F.try_to_timestamp(F.concat_ws("-", parts[2], parts[0], parts[1]), F.lit("yyyy-MM-dd")).cast("date")
    months = ((F.year(stamp) - 1800) * 12 + F.month(stamp)).cast("bigint")
    number = F.date_diff(stamp, first).cast("bigint") - months * 12
    one, two = LATE_DAYS
    new = feistel(F.array(F.floor(number / two), number % two), F.array(F.lit(one).cast("bigint"), F.lit(two).cast("bigint")), "month first", key)
    begins = lambda m: F.add_months(first, m)
    before = lambda m: F.date_diff(begins(m), first) - m * 12

    def write(n: Column) -> Column:
        index = (n[0] * two + n[1]).cast("int")
        # The mean gives the month up to one.
        guess = F.floor(index / F.lit(LATE_MEAN)).cast("int")
        month = lambda i: F.array_max(F.filter(F.sequence(F.greatest(guess - 1, F.lit(0)), guess + 1), lambda m: before(m) <= i))
        return _let(month(index), lambda m: F.date_format(F.date_add(begins(m), index - before(m) + 12), "MM/dd/yyyy"))
    return F.when((F.dayofmonth(stamp) > 12) & F.year(stamp).between(1800, 2199), _let(new, write)).otherwise(found)


def _characters(text: Column, alphabets: list[str], tweak: str, key: str) -> Column:
    """Characters of each alphabet permuted within it; others stay in place."""
    def place(c: Column) -> Column:
        at = F.lit(0)
        for alphabet in alphabets:
            at = F.when(F.position(c, F.lit(alphabet)) > 0, F.position(c, F.lit(alphabet)) - 1).otherwise(at)
        return at.cast("bigint")

    def size(c: Column) -> Column:
        n = F.lit(1)
        for alphabet in alphabets:
            n = F.when(F.position(c, F.lit(alphabet)) > 0, F.lit(len(alphabet))).otherwise(n)
        return n.cast("bigint")

    def written(c: Column, v: Column) -> Column:
        out = c
        for alphabet in alphabets:
            out = F.when(F.position(c, F.lit(alphabet)) > 0, F.substring(F.lit(alphabet), v.cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return _let(F.array_remove(F.split(text, ""), ""), lambda chars: F.array_join(F.zip_with(
        chars, feistel(F.transform(chars, place), F.transform(chars, size), tweak, key), written), ""))


def _email(found: Column, key: str) -> Column:
    local = F.regexp_extract(found, "^([^@]+)@", 1)
    return F.concat(_characters(local, ["0123456789", LETTERS, LETTERS.upper()], "email", key), F.regexp_extract(found, "(@.*)$", 1))


def pseudonym(found: Column, key: str) -> Column:
    """Pseudonym of one candidate; the candidate itself if it does not validate."""
    whole = lambda pattern: found.rlike(f"^(?:{pattern})$")
    return (
        F.when(found.contains("@"), _email(found, key))
        .when(whole(r"[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{5})"), _card(found, key))
        .when(whole("[0-9a-f]{32,64}"), _characters(found, ["0123456789abcdef"], "hex", key))
        .when(whole("[0-9A-F]{32,64}"), _characters(found, ["0123456789ABCDEF"], "hex", key))
        .when(whole("[0-9A-Fa-f]{32,64}"), _characters(found, ["0123456789", "abcdef", "ABCDEF"], "hex", key))
        .when(whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), _ip(found, key))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"), _date(found, key))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _social(found, key))
        .otherwise(_phone(found, key))
    )


def _rebuilt(text: Column, key: str) -> Column:
    """Struct ``(text, n)``: the text with all pseudonyms in place, and how many values changed."""
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return _let(F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))), lambda pairs: F.struct(
        F.array_join(F.zip_with(gaps, pairs, lambda g, p: F.concat(g, F.coalesce(p["new"], F.lit("")))), "").alias("text"),
        F.size(F.filter(pairs, lambda p: p["old"] != p["new"])).cast("bigint").alias("n"),
    ))


def with_counts(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_replaced`` of every document."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = F.when(F.col("text").rlike(ANY), _rebuilt(F.col("text"), key))
    return frame.select("doc_id", "text", done.alias("done")).select(
        "doc_id", F.coalesce("done.text", "text").alias("text"), F.coalesce("done.n", F.lit(0).cast("bigint")).alias("n_replaced"))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents, all columns kept, with pseudonyms in ``text``."""
    new = F.when(F.col(text).rlike(ANY), _rebuilt(F.col(text), key)["text"]).otherwise(F.col(text))
    return docs.select(*[new.alias(c) if c == text else docs[c] for c in docs.columns])
