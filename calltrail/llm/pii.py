"""Format-preserving pseudonyms of personal numbers, dates and addresses, with DataFrame operations only.

A keyed Feistel network permutes the values of a format among themselves, so equal values get equal
pseudonyms in all documents, and different values different ones. Every value is a row of characters
with a radix each: digits, letters and the parts of an address turn within their own range, all other
characters have the radix 1 and stay. Values that do not validate are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import fresh

ROUNDS = 8

_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![.]?\d)"
_DATE = r"\d{4}-\d{2}-\d{2}(?![-]?\d)|\d{4}/\d{2}/\d{2}(?![/]?\d)|\d{2}[./]\d{2}[./]\d{4}(?!\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![-]?\d)"
_PHONE = (
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)"
)
_CARD = r"\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"
_KEY = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password)=[^\s\"'<>]+|(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])"
# A value starts after no letter, no digit and no mark that joins it to a digit before.
PATTERN = rf"(?<![A-Za-z0-9])(?<![0-9][./-])(?:{_KEY}|{_EMAIL}|{_IPV4}|{_DATE}|{_SSN}|{_PHONE}|{_CARD})"
#: Every match has one of these characters.
HINT = r"[0-9@]|(?i:password)="

# 1800-01-01 to 2199-12-31 has 146,097 days, which is 189 * 773.
_DAYS, _DAY_RADIX = (189, 773), 773
_FIRST_DAY = "1800-01-01"


def _draws(key: str, salt: Column, turn: Column, half: Column, n: Column) -> Column:
    """n numbers below 65,536 from the key, the round and the other half."""
    text = F.array_join(F.transform(half, lambda c: c.cast("string")), ",")
    digest = F.sha2(F.concat_ws("|", F.lit(key), salt, turn.cast("string"), text), 256)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.arrays_zip(at.alias("i"), F.array_repeat(digest, n).alias("d")), lambda p: F.conv(F.substring(p["d"], 1 + 4 * (p["i"] % 16), F.lit(4)), 16, 10).cast("bigint"))


def feistel(codes: Column, radices: Column, salt: Column, key: str) -> Column:
    """A keyed permutation of the arrays with 0 <= codes[i] < radices[i].

    Each round adds numbers drawn from one half to the other half, modulo the radices. `salt`
    separates formats.
    """
    n = F.size(codes)
    cut = n.bitwiseAND(-2) / 2
    cut = cut.cast("int")

    def half(values: Column, right: Column) -> Column:
        return F.when(right, F.slice(values, cut + 1, n - cut)).otherwise(F.slice(values, F.lit(1), cut))

    left_radix, right_radix = half(radices, F.lit(True)), half(radices, F.lit(False))

    def turn(state: Column, k: Column) -> Column:
        # state: the half to change, the other half; they change places every round
        radix = F.when(k % 2 == 0, left_radix).otherwise(right_radix)
        draws = _draws(key, salt, k, state["other"], F.size(state["own"]))
        moved = F.zip_with(F.arrays_zip(state["own"].alias("c"), draws.alias("d")), radix, lambda p, r: (p["c"] + p["d"]) % r)
        return F.struct(state["other"].alias("own"), moved.alias("other"))

    start = F.struct(half(codes, F.lit(True)).alias("own"), half(codes, F.lit(False)).alias("other"))
    # after an even number of rounds `own` is the right half again
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["other"], s["own"]))


def _characters(value: Column, key: str, salt: Column, letters: int = 26) -> Column:
    """`value` with its digits and letters permuted, each within its class; letters of either case are the first `letters`."""
    def kind(c: Column) -> tuple[Column, Column]:
        code = F.ascii(c).cast("bigint")
        one = F.length(c) == 1
        digit, upper, lower = one & c.between("0", "9"), one & c.between("A", "Z"), one & c.between("a", "z")
        base = F.when(digit, 48).when(upper, 65).when(lower, 97).otherwise(code).cast("bigint")
        radix = F.when(digit, 10).when(upper | lower, letters).otherwise(1).cast("bigint")
        return base, radix

    chars = F.split(value, "")
    codes = F.transform(chars, lambda c: F.ascii(c).cast("bigint") - kind(c)[0])
    radices = F.transform(chars, lambda c: kind(c)[1])
    out = F.zip_with(chars, feistel(codes, radices, salt, key), lambda c, v: F.when(kind(c)[1] == 1, c).otherwise(F.char(kind(c)[0] + v)))
    return F.array_join(out, "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum of the digits, of which every second one from the right is doubled."""
    def add(acc: Column, p: Column) -> Column:
        double = p["d"] * 2
        return acc + F.when(p["i"] % 2 == doubled_from, F.when(double > 9, double - 9).otherwise(double)).otherwise(p["d"])

    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    spots = F.arrays_zip(numbers.alias("d"), F.sequence(F.lit(0), F.size(numbers) - 1).alias("i"))
    return F.aggregate(spots, F.lit(0), add)


def _spread(template: Column, digits: Column) -> Column:
    """`template` with its digits replaced by `digits` in order."""
    gaps = F.split(template, "[0-9]", -1)
    return F.array_join(F.flatten(F.zip_with(gaps, F.split(digits, ""), lambda g, d: F.array(g, F.coalesce(d, F.lit(""))))), "")


# Numbers that card networks issue, by first digits and length (ISO/IEC 7812). Of other numbers one in ten
# has a right Luhn sum by chance.
_ISSUED = (
    r"^(?:4\d{12}(?:\d{3}){0,2}|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}"
    r"|35(?:2[89]|[3-8]\d)\d{12,15}|(?:6011|64[4-9]\d|65\d\d|62\d\d)\d{12,15}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15})$"
)
_ISSUER = 4  # digits that tell the network and stay


def _card(value: Column, key: str) -> Column:
    """The digits after the network's are permuted, but for the last, which makes the Luhn sum right again."""
    digits = _digits(value)
    middle = F.substring(digits, F.lit(_ISSUER + 1), F.length(digits) - _ISSUER - 1)
    body = F.concat(F.substring(digits, 1, _ISSUER), _characters(middle, key, F.lit("card")))
    check = (10 - luhn_sum(body, 0) % 10) % 10
    fine = digits.rlike(_ISSUED) & (luhn_sum(digits, 1) % 10 == 0)
    return F.when(fine, _spread(value, F.concat(body, check.cast("string")))).otherwise(value)


def _ipv4(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda c: c.cast("bigint"))
    fine = F.forall(parts, lambda p: p <= 255) & ~value.rlike(r"(^|\.)0\d")
    new = feistel(parts, F.array_repeat(F.lit(256).cast("bigint"), 4), F.lit("ipv4"), key)
    return F.when(fine, F.array_join(F.transform(new, lambda c: c.cast("string")), ".")).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999 are permuted among themselves."""
    area, group, serial = (F.split(value, "-")[i].cast("bigint") for i in range(3))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    codes = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    radices = F.array(*[F.lit(r).cast("bigint") for r in (898, 99, 9999)])
    new = F.transform(feistel(codes, radices, F.lit("ssn"), key), lambda c: c + 1)

    def text(n: Column) -> Column:
        shown = n[0] + F.when(n[0] > 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(shown.cast("string"), 3, "0"), F.lpad(n[1].cast("string"), 2, "0"), F.lpad(n[2].cast("string"), 4, "0"))

    # one evaluation of the permutation, then its three parts
    return F.when(fine, F.transform(F.array(new), text)[0]).otherwise(value)


def _date(value: Column, key: str) -> Column:
    """The days of four centuries are permuted. Day before month where the year stands last, else month before day if only that is a date."""
    forms = [
        (r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/\d{2}/", "dd/MM/yyyy"),
        (r"^\d{2}/\d{2}/", "MM/dd/yyyy"),
    ]
    first = F.lit(_FIRST_DAY).cast("date")
    out = value
    for start, form in reversed(forms):
        day = F.to_date(F.try_to_timestamp(value, F.lit(form)))
        number = F.datediff(day, first).cast("bigint")
        fine = value.rlike(start) & number.between(0, _DAYS[0] * _DAYS[1] - 1)
        codes = F.array(F.floor(number / _DAY_RADIX), number % _DAY_RADIX)
        new = feistel(codes, F.array(*[F.lit(r).cast("bigint") for r in _DAYS]), F.lit("date"), key)
        shown = F.transform(F.array(new), lambda n: F.date_format(F.date_add(first, (n[0] * _DAY_RADIX + n[1]).cast("int")), form))[0]
        out = F.when(fine, shown).otherwise(out)
    return out


def _prefixed(value: Column, prefix: str, key: str, salt: str) -> Column:
    """All after the match of `prefix` is permuted."""
    head = F.regexp_extract(value, prefix, 0)
    return F.concat(head, _characters(F.substring(value, F.length(head) + 1, F.length(value)), key, F.lit(salt)))


def _email(value: Column, key: str) -> Column:
    """The part before the @ is permuted; the domain stays."""
    local = F.substring_index(value, "@", 1)
    return F.concat(_characters(local, key, F.lit("email")), F.substring(value, F.length(local) + 1, F.length(value)))


# The country codes of ITU-T E.164; all not listed with one or two digits have three.
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _phone(value: Column, key: str) -> Column:
    """The national digits are permuted, so a number links with itself in any notation; marks and country code stay."""
    fine = F.length(_digits(value)).between(7, 15)
    code = F.regexp_extract(value, COUNTRY_CODE, 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.when(fine, F.concat(code, _spread(rest, _characters(_digits(rest), key, F.lit("phone"))))).otherwise(value)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a match of PATTERN; the value itself if it does not validate."""
    return (
        F.when(value.rlike("^(?:AKIA|(?i:password)=)"), _prefixed(value, "^(?:AKIA|(?i:password)=)", key, "secret"))
        .when(value.contains("@"), _email(value, key))
        .when(value.rlike("^(?:[0-9a-f]{40}|[0-9A-F]{40})$") & value.rlike("[A-Fa-f]"), _characters(value, key, F.lit("hex"), 6))
        .when(value.rlike(f"^(?:{_IPV4})$"), _ipv4(value, key))
        .when(value.rlike(f"^(?:{_DATE})$"), _date(value, key))
        .when(value.rlike(f"^(?:{_SSN})$"), _ssn(value, key))
        .when(value.rlike(f"^(?:{_PHONE})$"), _phone(value, key))
        .when(value.rlike(f"^(?:{_CARD})$"), _card(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with every personal value of `text` replaced, in all rows and with all columns.

    The same key gives the same pseudonyms everywhere. Null and empty texts stay. Emails keep their
    domain, phone numbers their country code, secrets their prefix; card numbers keep their network and a right
    Luhn sum, and dates stay dates of 1800 to 2199 in their own notation.
    """
    values, parts = fresh(docs, "_values"), fresh(docs, "_parts")
    # texts without a hint skip the search
    hint = F.col("text").rlike(HINT)
    found = docs.withColumn(values, F.when(hint, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    found = found.withColumn(parts, F.when(F.size(values) > 0, F.split("text", PATTERN, -1)))
    new = F.transform(values, lambda v: pseudonym(v, key))
    text = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    return found.withColumn("text", F.when(F.size(values) > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found (values that look personal), changed of every row; null text stays null with 0 found."""
    plain = docs.select("doc_id", "text")
    found = plain.select("doc_id", "text", F.col("text").alias("before"))
    new = pseudonymise(found, key)
    count = F.when(F.col("before").rlike(HINT), F.regexp_count("before", F.lit(PATTERN))).otherwise(0)
    return new.select("doc_id", "text", F.coalesce(count, F.lit(0)).alias("n_found"), (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))
