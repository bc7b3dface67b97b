"""Personal data: keyed format-preserving pseudonyms, in column expressions only.

One pattern finds candidates; each is validated by its kind and then permuted
within its format by a Feistel network, so that a value becomes the same
pseudonym in every document and different values stay different:

* card numbers (13-19 digits, Luhn): all digits but the last are permuted and
  the check digit is made anew; separators stay.
* dates: the day number is permuted within its block of 65,536 days. Each string
  is read in one way only: a slash date is month first if its first part is at
  most 12, else day first; the latter are permuted among themselves.
* US social security numbers: permuted among the numbers that may be issued.
* phone numbers: the national digits are permuted; international numbers keep
  their first digits (the country code where a separator ends it, else two).
* IBAN (checked modulo 97): letters and digits after the check digits are
  permuted and the check digits made anew.
* IPv4 addresses: permuted among all addresses.
* e-mail addresses (before the @) and secrets after ``password=``, ``token =``
  and the like, and access key ids: each character is permuted within its class
  (digits, lower case, upper case, and runs of letters of other scripts; see
  CLASSES). A permutation may leave a value as it is; marks and letters outside
  of the classes always stay.

Numbers are split in two residues; 16 half rounds add a keyed hash of one to the
other. Characters are treated alike, in two halves of the string.

The key is the Spark setting ``spark.sparkloom.pseudonym.key``, or an argument.

Defined results: null stays null and counts 0; an empty text stays empty;
candidates that fail validation stay as they are; repeated rows are treated
alike. Extra columns are kept. Patterns never backtrack over unbounded runs, so
very long texts and values neither overflow the stack nor cost more than their
length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Whoever runs this on real data sets a secret key; this one is for tests.
KEY_SETTING, KEY = "spark.sparkloom.pseudonym.key", "change-me"
HALF_ROUNDS = 16

#: The formats that are looked for, in order of preference.
EMAIL = (
    r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@"
    r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,125}(?<=\.[\p{L}\p{N}-]{0,62}\p{L}{2})"
)
LABEL = r"(?i:password|passwd|token|secret|api[_-]?key)\s*+[=:]\s*+[\"']?"
SECRET = LABEL + r"[^\s\"']{8,}+"
ACCESS_KEY = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![0-9A-Z])"
IBAN_COUNTRIES = (
    "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|"
    "KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
)
IBAN = rf"(?<![0-9A-Z])(?:{IBAN_COUNTRIES})\d{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z])"
DATE = (
    r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[/.-]\d)"
)
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
INTERNATIONAL = (
    r"(?<![\w+])\+(?:\d{9,15}|\d{1,3}[ .-](?:\d(?:[ .-]\d{2}){4}|\d{2,3}(?:[ .-]\d{2,3}){3}"
    r"|(?:\(\d{2,5}\)|\d{2,5})(?:[ .-]\d{3,8}){1,2}))(?!\d)"
)
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
KINDS = {
    "email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "iban": IBAN, "date": DATE,
    "ssn": SSN, "phone": PHONE, "international": INTERNATIONAL, "ipv4": IPV4, "card": CARD,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: No pattern can match without one of these characters.
HINT = "[0-9@=:]"
#: First code point and length of runs of digits or letters that a
#: character stays within.
CLASSES = (
    (0x30, 10), (0x61, 26), (0x41, 26),  # 0-9, a-z, A-Z
    (0xDF, 24), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x100, 128), (0x180, 208),  # Latin with accents
    (0x3B1, 25), (0x391, 17), (0x3A3, 7), (0x3AC, 4), (0x3CA, 5),  # Greek
    (0x430, 32), (0x410, 32), (0x450, 16), (0x400, 16),  # Cyrillic
    (0x561, 38), (0x531, 38), (0x5D0, 27), (0x620, 32), (0x641, 10),  # Armenian, Hebrew, Arabic
    (0x904, 54), (0xE01, 48), (0x10D0, 43),  # Devanagari, Thai, Georgian
    (0x3041, 86), (0x30A1, 90), (0x3400, 6592), (0x4E00, 20976), (0xAC00, 11172),  # kana, Han, Hangul
)


def _digest(key: str, kind: str, step: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)


def _keyed(key: str, kind: str, step: Column, value: Column) -> Column:
    """A 60-bit number from the key, the half round and a value."""
    return F.conv(F.substring(_digest(key, kind, step, value), 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, m: Column, n: Column, kind: str, key: str, finish=None) -> Column:
    """Struct (l, r): the pair (left mod m, right mod n) under a keyed
    permutation, or what ``finish`` makes of it."""

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.cast("long").alias("l"), b.cast("long").alias("r"))

    def half_round(s: Column, step: Column) -> Column:
        side = F.when(step % 2 == 1, m).otherwise(n)
        return pair(s["r"], (s["l"] + _keyed(key, kind, step, s["r"])) % side)  # the halves change places

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALF_ROUNDS)), pair(left, right), half_round, finish)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out a single time."""
    return F.transform(F.array(value), use)[0]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _character(code: Column) -> Column:
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code < 128, F.char(code)).otherwise(wide)


def _shifted(s: Column, digest: Column) -> Column:
    """Each character moved within its class by 32 bits of a key stream."""

    def stream(seed: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / 8), F.lit(0)).cast("int"))
        return F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256))

    ascii_only, classes = (
        F.from_json(F.lit(json.dumps([{"first": a, "n": n} for a, n in some])), "array<struct<first:int,n:int>>")
        for some in (CLASSES[:3], CLASSES)
    )

    def moved(code: Column, i: Column, blocks: Column) -> Column:
        eight = F.substring(F.element_at(blocks, (i / 8).cast("int") + 1), (i % 8) * 8 + 1, F.lit(8))
        by = F.conv(eight, 16, 10).cast("long")
        own = F.filter(F.when(code < 128, ascii_only).otherwise(classes), lambda x: code.between(x["first"], x["first"] + x["n"] - 1))
        put = F.transform(own, lambda x: ((code - x["first"] + by) % x["n"] + x["first"]).cast("int"))
        return _character(F.coalesce(F.get(put, F.lit(0)), code))

    def all_moved(blocks: Column) -> Column:
        return F.array_join(F.transform(F.transform(_chars(s), F.ascii), lambda c, i: moved(c, i, blocks)), "")

    return _once(digest, lambda seed: _once(stream(seed), all_moved))


def permuted_text(s: Column, kind: str, key: str) -> Column:
    """The string with every character permuted within its class."""
    half = F.floor(F.length(s) / 2).cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("l"), b.alias("r"))

    def half_round(x: Column, step: Column) -> Column:
        return pair(x["r"], _shifted(x["l"], _digest(key, kind, step, x["r"])))  # the halves change places

    start = pair(F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s)))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), start, half_round, lambda x: F.concat(x["l"], x["r"])
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _padded(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def _power(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _with_digits(s: Column, digits: Column) -> Column:
    """The string with its digits, in order, replaced by ``digits``."""

    def put(c: Column, i: Column, new: Column) -> Column:
        nth = F.length(_digits(F.substring(s, F.lit(1), i + 1)))
        return F.when(c.between("0", "9"), F.substring(new, nth, F.lit(1))).otherwise(c)

    return _once(digits, lambda new: F.array_join(F.transform(_chars(s), lambda c, i: put(c, i, new)), ""))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits, every second one doubled; counted from the right, those at
    even (``doubled`` 0) or odd (1) places from 0 are doubled."""

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when(x["i"] % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x["d"])

    places = F.transform(
        _chars(F.reverse(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))
    )
    return F.aggregate(places, F.lit(0), add)


def _split_permuted(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    left = F.substring(digits, F.lit(1), h).cast("long")
    right = F.substring(digits, h + 1, n).cast("long")
    return permuted(
        left, right, _power(h), _power(n - h), kind, key,
        lambda x: F.concat(_padded(x["l"], h), _padded(x["r"], n - h)),
    )


def is_card(s: Column) -> Column:
    return _luhn_sum(_digits(s), 1) % 10 == 0


def card_pseudonym(s: Column, key: str) -> Column:
    digits = _digits(s)
    body = _split_permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = _once(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
    return _with_digits(s, check)


def phone_pseudonym(s: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code stays."""
    digits = _digits(s)
    code = F.substring(digits, F.lit(1), F.length(digits) - 10)
    national = F.substring(digits, F.length(digits) - 9, F.lit(10))
    return _with_digits(s, F.concat(code, _split_permuted(national, "phone", key)))


def is_international(s: Column) -> Column:
    return F.length(_digits(s)).between(9, 15)


def international_pseudonym(s: Column, key: str) -> Column:
    digits = _digits(s)
    code = F.regexp_extract(s, r"^\+(\d{1,3})[ .-]", 1)
    n = F.when(code != "", F.length(code)).otherwise(2)
    rest = F.substring(digits, n + 1, F.length(digits))
    return _with_digits(s, F.concat(F.substring(digits, F.lit(1), n), _split_permuted(rest, "phone", key)))


def _modulo_97(s: Column) -> Column:
    """Remainder of letters and digits read as one number (A is 10, Z is 35)."""

    def read(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), read)


def is_iban(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.length(plain).between(15, 34) & (_modulo_97(turned) == 1)


def iban_pseudonym(s: Column, key: str) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)

    def written(body: Column) -> Column:
        check = F.lit(98) - _modulo_97(F.concat(body, country, F.lit("00")))
        return _with_gaps(s, F.concat(country, F.lpad(check.cast("string"), 2, "0"), body))

    return _once(permuted_text(F.substring(plain, F.lit(5), F.length(plain)), "iban", key), written)


def _with_gaps(s: Column, new: Column) -> Column:
    """``new`` with the spaces of ``s`` in their places."""

    def put(c: Column, i: Column) -> Column:
        nth = F.length(F.replace(F.substring(s, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(new, nth, F.lit(1)))

    return F.array_join(F.transform(_chars(s), put), "")


def is_ipv4(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda x: x.cast("int") <= 255)


def ipv4_pseudonym(s: Column, key: str) -> Column:
    octet = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    side = F.lit(65536)
    parts = [lambda x: x["l"] / 256, lambda x: x["l"] % 256, lambda x: x["r"] / 256, lambda x: x["r"] % 256]
    return permuted(
        octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], side, side, "ipv4", key,
        lambda x: F.concat_ws(".", *(F.floor(p(x)).cast("string") for p in parts)),
    )


def _ssn(s: Column) -> tuple[Column, Column, Column]:
    return tuple(p.cast("int") for p in (F.substring(s, 1, 3), F.substring(s, 5, 2), F.substring(s, 8, 4)))


def is_ssn(s: Column) -> Column:
    area, group, serial = _ssn(s)
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def ssn_pseudonym(s: Column, key: str) -> Column:
    area, group, serial = _ssn(s)
    place = area - F.when(area > 666, 2).otherwise(1)  # 898 areas

    def written(x: Column) -> Column:
        area = F.floor(x["l"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        parts = ((area, 3), (x["l"] % 99 + 1, 2), (x["r"] + 1, 4))
        return F.concat_ws("-", *(_padded(v, F.lit(w)) for v, w in parts))

    return permuted(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key, written)


#: How a date of each form is read.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def _by_form(s: Column, use) -> Column:
    """``use(form)`` for the one form that the string is read in."""
    mark = F.substring(s, 5, 1)
    iso, slashed, dotted, month_first, day_first = (use(f) for f in DATE_FORMS)
    return (
        F.when(mark == "-", iso)
        .when(mark == "/", slashed)
        .when(F.substring(s, 3, 1) == ".", dotted)
        .when(F.substring(s, 1, 2).cast("int") <= 12, month_first)
        .otherwise(day_first)
    )


def is_date(s: Column) -> Column:
    """A day that exists, up to the last block that ends within year 9999."""
    last = F.to_timestamp(F.lit("9869-01-01"))
    return F.coalesce(_by_form(s, lambda form: F.try_to_timestamp(s, F.lit(form))) < last, F.lit(False))


def _day(number: Column) -> Column:
    return F.date_add(F.to_date(F.lit("0001-01-01")), number.cast("int"))


def date_pseudonym(s: Column, key: str) -> Column:
    read = _by_form(s, lambda form: F.try_to_timestamp(s, F.lit(form)))
    number = F.datediff(read, F.to_date(F.lit("0001-01-01"))).cast("long")

    def walk(day: Column, i: Column) -> Column:
        block = F.floor(day / 65536) * 65536
        new = permuted(
            F.floor(day % 65536 / 256), day % 256, F.lit(256), F.lit(256), "date", key,
            lambda x: block + x["l"] * 256 + x["r"],
        )
        # a day-first slash date goes on until it is read day first again
        first_two = F.substring(s, 1, 2).cast("int")
        again = (F.substring(s, 3, 1) == "/") & (first_two > 12) & (F.dayofmonth(_day(day)) <= 12)
        return F.when((i == 0) | again, new).otherwise(day)

    new = F.aggregate(F.sequence(F.lit(0), F.lit(100)), number, walk)
    return _once(new, lambda day: _by_form(s, lambda form: F.date_format(_day(day), form)))


def secret_pseudonym(s: Column, key: str) -> Column:
    label = F.regexp_extract(s, f"^(?:{LABEL})", 0)
    return F.concat(label, permuted_text(F.substring(s, F.length(label) + 1, F.length(s)), "secret", key))


def email_pseudonym(s: Column, key: str) -> Column:
    at = F.instr(s, "@")
    return F.concat(permuted_text(F.substring(s, F.lit(1), at - 1), "email", key), F.substring(s, at, F.length(s)))


def access_key_pseudonym(s: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permuted_text(F.substring(s, F.lit(5), F.length(s)), "access_key", key))


RULES = {
    "email": (None, email_pseudonym),
    "access_key": (None, access_key_pseudonym),
    "secret": (None, secret_pseudonym),
    "iban": (is_iban, iban_pseudonym),
    "date": (is_date, date_pseudonym),
    "ssn": (is_ssn, ssn_pseudonym),
    "phone": (None, phone_pseudonym),
    "international": (is_international, international_pseudonym),
    "ipv4": (is_ipv4, ipv4_pseudonym),
    "card": (is_card, card_pseudonym),
}


def pseudonym(s: Column, key: str = KEY) -> Column:
    """What a match becomes: by its kind if it is valid, else itself."""
    out = s
    for kind, pattern in reversed(KINDS.items()):
        valid, make = RULES[kind]
        fits = s.rlike(f"^(?:{pattern})$")
        out = F.when(fits & valid(s) if valid else fits, make(s, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``docs`` with every valid value in ``text`` replaced, and their number in
    the column ``count`` (None: no such column).

    The text is cut at all matches and put together again with their
    pseudonyms, so nothing else in it changes.
    """
    value, found, new = F.col(text), fresh(docs, "pii_found"), fresh(docs, "pii_new")
    matches = F.regexp_extract_all(value, F.lit(ANY), F.lit(0))
    some = docs.withColumn(found, F.when(value.rlike(HINT), matches))
    some = some.withColumn(found, F.when(F.size(found) > 0, F.col(found)))
    some = some.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    joined = F.array_join(
        F.zip_with(F.split(value, ANY, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), ""
    )
    changed = F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)
    if count is not None:
        some = some.withColumn(count, F.coalesce(F.size(changed), F.lit(0)).cast("long"))
    some = some.withColumn(text, F.when(F.col(found).isNull(), value).otherwise(joined))
    return some.drop(found, new)


def _key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, _key(spark)).select("doc_id", "n_replaced", "text")


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, _key(spark), count=None)
