"""Format-preserving pseudonyms for personal data: keyed Feistel permutations in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of telephone numbers: international by groups (the first may be in parentheses), international without separators, national.
_PHONES = (
    r"\+\d{1,3}[ -](?:\(\d{2,4}\)|\d{2,4})[ -]\d{3,4}[ -]\d{3,4}(?!\w)",
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)",
    r"\+\d{1,3}[ .-](?:\(\d{1,3}\)|\d{1,3})[ .-](?:\d{2}[ .-]\d{2}[ .-]\d{2}(?:[ .-]\d{2})?|\d{3}[ .-]\d{2}[ .-]\d{2}|\d{3,4}[ .-]\d{3,4})(?!\w)",
    r"\+\d{1,3}[ .-](?:\d{4}[ .-]\d{4}|\d{5}[ .-]\d{5}|\d{2}[ .-]\d{5}[ .-]\d{4}|\d{2,4}[ .-]\d{5,8}|\d{6,12})(?!\w)",
    r"(?<!\w)\+\d{8,15}(?!\w)",
    r"(?<!\w)\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])",
    r"(?<![\w.-])\d{3}[ .-]\d{3,4}[ .-]\d{4}(?![\w-]|[ .]\d)",
    r"(?<![\w.-])0\d(?:[ .-]\d{2}){4}(?![\w-]|[ .]\d)",
)
#: The part of them that stays: the country code, and the zero of a national number by pairs.
_PHONE_HEAD = (r"^(?:\+\d{1,3}(?=\D)|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
               r"|0(?=\d(?:[ .-]\d{2}){4}$))?")

#: Kinds in the order they are tried, each with its pattern.
PATTERNS = {
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key)\s?[=:]\s?\"?[A-Za-z0-9]{6,}\"?",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[\w+-])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "phone": "|".join(_PHONES),
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{4,5}))(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "iso_date": r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d{2}:?\d{2})|(?![\w-]))",
    "day_date": r"(?<![\w.-])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)|(?<![\w./])(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{1,2}/\d{1,2})(?!\w|/|\.\d)",
}
# The back reference of "card" counts its own group; it is the only capturing one.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Account numbers by length, for those printed in fours: the length tells where the number ends and the next word begins.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_PRINTED_IBAN = "|".join(
    rf"(?:{of.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, of in _IBAN_COUNTRIES.items())

#: Days from 1900-01-01 to 2099-12-31: 73,049 = 319 * 229, so two digits of those bases need no walking.
_DAYS = (319, 229)
#: Valid areas (1 to 899 without 666), and groups and serials without zero.
_SSN = (898, 99 * 9999)
_ROUNDS = 6


def _stream(key: str, tag: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tag}|"), step.cast("string"), F.lit("|"), other), 256)


def _number(hex64: Column, at: Column | int = 1, digits: int = 12) -> Column:
    return F.conv(F.substr(hex64, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _shifted(text: Column, stream: Column) -> Column:
    """Every digit and letter moved within its own class by its place in ``stream``."""
    def move(c: Column, i: Column) -> Column:
        k = _number(stream, i % 32 * 2 + 1, 2)
        within = lambda first, n: F.chr(F.lit(ord(first)) + (F.ascii(c) - ord(first) + k) % n)
        return (F.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26))
                .when(c.rlike("^[A-Z]$"), within("A", 26)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute_text(text: Column, key: str, tag: str) -> Column:
    """A permutation of strings that keeps every place's class (digit, a-z, A-Z, other)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_ROUNDS)), start,
        lambda a, i: F.struct(a["r"].alias("l"), _shifted(a["l"], _stream(key, tag, i, a["r"])).alias("r")),
        lambda a: F.concat(a["l"], a["r"]))


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tag: str) -> Column:
    """A permutation of pairs (l, r) with l < sizes[0] and r < sizes[1], as a struct."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    def turn(a: Column, i: Column) -> Column:
        l = (a["l"] + _number(_stream(key, tag + "l", i, a["r"].cast("string")))) % sizes[0]  # noqa: E741
        r = (a["r"] + _number(_stream(key, tag + "r", i, l.cast("string")))) % sizes[1]
        return F.struct(l.alias("l"), r.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS // 2)), start, turn)


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn sum; ``from_right`` is the place of the last digit, 0 for a check digit."""
    def part(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when((i + from_right) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x)


def _refilled(shape: Column, chars: Column) -> Column:
    """``shape`` with its letters and digits replaced in order by ``chars``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("p"))
    return F.aggregate(F.split(shape, ""), start, lambda a, c: F.when(
        c.rlike("^[0-9A-Za-z]$"),
        F.struct(F.concat(a["o"], F.substr(chars, a["p"], F.lit(1))).alias("o"), (a["p"] + 1).alias("p")),
    ).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["p"].alias("p"))), lambda a: a["o"])


def _plain(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _card(m: Column, key: str) -> Column:
    digits = _plain(m)
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    def whole(b: Column) -> Column:
        return _refilled(m, F.concat(b, ((10 - _luhn_sum(b, 1) % 10) % 10).cast("string")))
    new = F.element_at(F.transform(F.array(body), whole), 1)
    return F.when(_luhn_sum(digits, 0) % 10 == 0, new)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    high, low = part[0] * 256 + part[1], part[2] * 256 + part[3]
    def text(p: Column) -> Column:
        return F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)
    new = F.element_at(F.transform(F.array(permute_pair(high, low, (65536, 65536), key, "ip")), text), 1)
    return F.when(F.forall(part, lambda x: x <= 255), new)


def _date(m: Column, key: str, pattern: str, padded: str) -> Column:
    """``pattern`` reads one or two digits; two-digit days and months are written as ``padded``, others as ``pattern``."""
    day = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), F.lit("1900-01-01").cast("date"))
    def text(p: Column) -> Column:
        new = F.date_add(F.lit("1900-01-01").cast("date"), p.cast("int"))
        both = r"^(?:\d\d\D\d\d\D\d{4}|\d{4}\D\d\d\D\d\d)$"
        return F.when(m.rlike(both), F.date_format(new, padded)).otherwise(F.date_format(new, pattern))
    pair = permute_pair(F.floor(day / _DAYS[1]), day % _DAYS[1], _DAYS, key, "date")
    new = F.element_at(F.transform(F.array(pair["l"] * _DAYS[1] + pair["r"]), text), 1)
    return F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), new)


def _day_date(m: Column, key: str) -> Column:
    """With points the day comes first; with slashes the month, or the day where it can't be a month."""
    return F.when(m.contains("."), _date(m, key, "d.M.yyyy", "dd.MM.yyyy")).when(
        m.rlike(r"^\d{4}"), _date(m, key, "yyyy/M/d", "yyyy/MM/dd")).otherwise(
        F.coalesce(_date(m, key, "M/d/yyyy", "MM/dd/yyyy"), _date(m, key, "d/M/yyyy", "dd/MM/yyyy")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    left = area - F.when(area > 666, 2).otherwise(1)
    pair = permute_pair(left, (group - 1) * 9999 + serial - 1, _SSN, key, "ssn")
    def text(p: Column) -> Column:
        a = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"),
                           F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.element_at(F.transform(F.array(pair), text), 1))


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    plain = _plain(m)
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    def whole(b: Column) -> Column:
        return _refilled(m, F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    new = F.element_at(F.transform(F.array(permute_text(body, key, "iban")), whole), 1)
    return F.when(_valid_iban(m), new)


def _valid_iban(m: Column) -> Column:
    plain = _plain(m)
    return _mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1


def _printed_ibans(text: Column) -> Column:
    """The valid account numbers in fours; candidates may overlap, so none that fails hides another."""
    each = F.regexp_extract_all(text, F.lit(rf"(?<!\w)(?=((?:{_PRINTED_IBAN})(?!\w)))"), F.lit(1))
    return F.array_distinct(F.filter(each, _valid_iban))


def _after(pattern: str, tag: str) -> Callable[[Column, str], Column]:
    """Keeps what ``pattern`` matches at the start and permutes the rest."""
    def made(m: Column, key: str) -> Column:
        head = F.regexp_extract(m, pattern, 0)
        rest = F.substr(m, F.length(head) + 1)
        return F.concat(head, _refilled(rest, permute_text(_plain(rest), key, tag)))
    return made


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(_refilled(name, permute_text(_plain(name), key, "email")), F.substr(m, F.length(name) + 1))


_MAKE: dict[str, Callable[[Column, str], Column]] = {
    "secret": _after(r"^[^=:]*[=:]\s?\"?", "secret"),
    "key": _after("^AKIA", "key"),
    "email": _email,
    "ip": _ip,
    "phone": _after(_PHONE_HEAD, "phone"),
    "card": _card,
    "ssn": _ssn,
    "iban": _iban,
    "iso_date": lambda m, key: _date(m, key, "yyyy-MM-dd", "yyyy-MM-dd"),
    "day_date": _day_date,
}


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and the number of each kind (``n_<kind>``).

    Candidates are found by pattern and checked: card numbers by their check
    digit, account numbers modulo 97, addresses by their range, dates by the
    calendar from 1900 to 2099, social security numbers by their ranges; what
    fails is left. A pseudonym has the shape of the value and passes the same
    check; a key gives one value one pseudonym in every document, whatever
    separators it is written with. Country codes, mail domains and the words
    before a secret are kept. Who knows ``key`` can undo it: there is no default,
    and an empty one is refused.

    Written forms: phones with + by groups of the usual lengths or without
    separators, with an area in parentheses, as 3-3-4 or 3-4-4 digits, and by
    pairs after a zero; cards in one piece, in fours or as 4-6-5 and 4-6-4;
    account numbers in one piece or, of the countries in the registry, in fours;
    dates as year-month-day, also before a time, day.month.year, month/day/year
    (day/month/year where the first can't be a month) and year/month/day. Left
    out: national phones without separators or by other groups, numbers after 00
    for +, extensions, account numbers with other separators or in small letters,
    social security numbers without hyphens, IPv6 addresses, dates with the
    month's name, two-digit years, or no separators, and the times themselves.

    A null text stays null and has no finds; an empty one stays empty. Rows are
    independent: repeated rows give repeated results, extra columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    if not key:
        raise ValueError("a key is needed")
    source = F.col("text")
    printed = F.when(source.rlike(rf"(?<!\w)(?:{_PRINTED_IBAN})(?!\w)"), _printed_ibans(source)).otherwise(F.array().cast("array<string>"))
    # Only account numbers that are valid enter the search, as they stand; so what merely looks like one hides nothing.
    more = F.concat(F.lit(r"(?<!\w)(?:"), F.array_join("printed", "|"), F.lit(rf")(?!\w)|{ANY}"))
    def searched(by: Callable[[Column], Column]) -> Column:
        return F.when(F.size("printed") > 0, by(more)).otherwise(by(F.lit(ANY)))
    matches = F.when(source.rlike("[0-9@=:]|AKIA"), searched(lambda p: F.regexp_extract_all(source, p, F.lit(0)))).otherwise(
        F.array().cast("array<string>"))
    def new(m: Column) -> Column:
        out = None
        for kind, make in _MAKE.items():
            hit = m.rlike(f"^(?:{_bare(kind)}{'|' + _PRINTED_IBAN if kind == 'iban' else ''})$")
            value = F.struct(F.lit(kind).alias("kind"), make(m, key).alias("new"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("printed", printed).withColumn("matches", matches)
    rows = rows.withColumn("found", F.transform("matches", new))
    pieces = searched(lambda p: F.split(source, p, -1))
    rebuilt = F.array_join(F.flatten(F.zip_with(
        pieces, F.zip_with("matches", "found", lambda m, f: F.coalesce(f["new"], m)),
        lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    rows = rows.withColumn("out", F.when(F.size("matches") > 0, rebuilt).otherwise(source))
    valid = F.filter("found", lambda f: f["new"].isNotNull())
    count = lambda kind: F.size(F.filter("found", lambda f: f["new"].isNotNull() & (f["kind"] == kind)))
    none = F.col("text").isNull()
    return rows.select(
        "doc_id", F.col("out").alias("text"), F.when(none, 0).otherwise(F.size(valid)).cast("long").alias("n_found"),
        *[F.when(none, 0).otherwise(count(kind)).cast("long").alias(f"n_{kind}") for kind in PATTERNS])


def _bare(kind: str) -> str:
    """The kind's pattern without what it asks of the characters around it."""
    pattern = PATTERNS[kind]
    for around in (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])", r"(?<![\w.+-])", r"(?<![\w.-])", r"(?<![\w.])", r"(?<![\w-])",
                   r"(?<!\w)", r"(?![\w-])", r"(?!\w|\.\d)", r"(?!\w)"):
        pattern = pattern.replace(around, "")
    return pattern
