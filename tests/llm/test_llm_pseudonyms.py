"""Pseudonyms against a scanner and a Feistel cipher in plain Python."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from slotwise.llm import pseudonyms
from slotwise.llm.common import table

KEY = "k3y"
DAY0 = datetime.date(1900, 1, 1)


def digest(tag, step, other):
    return hashlib.sha256(f"{KEY}|{tag}|{step}|{other}".encode()).hexdigest()


def letters(text, tag):
    left, right = text[:len(text) // 2], text[len(text) // 2:]
    for step in range(1, 7):
        mixed, pad = "", bytes.fromhex(digest(tag, step, right))
        for i, c in enumerate(left):
            first, n = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
            mixed += chr(ord(first) + (ord(c) - ord(first) + pad[i % 32]) % n)
        left, right = right, mixed
    return left + right


def pair(left, right, sizes, tag):
    for step in (1, 2, 3):
        left = (left + int(digest(tag + "l", step, right)[:12], 16)) % sizes[0]
        right = (right + int(digest(tag + "r", step, left)[:12], 16)) % sizes[1]
    return left, right


def refill(shape, chars):
    chars = iter(chars)
    return "".join(next(chars) if re.match("[0-9A-Za-z]", c) else c for c in shape)


def plain(text):
    return re.sub("[^0-9A-Za-z]", "", text)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def rest97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban_ok(m):
    p = plain(m)
    return rest97(p[4:] + p[:4]) == 1


def after(head, m, tag):
    return m[:head] + refill(m[head:], letters(plain(m[head:]), tag))


def moved_day(day):
    n = (day - DAY0).days
    if not 0 <= n < 319 * 229:
        return None
    high, low = pair(n // 229, n % 229, (319, 229), "date")
    return DAY0 + datetime.timedelta(high * 229 + low)


def date(m, order):
    parts = re.split(r"\D", m)
    try:
        new = moved_day(datetime.date(*(int(parts[order.index(x)]) for x in "ymd")))
    except ValueError:
        return None
    if new is None:
        return None
    wide = {len(p) for p in parts} == {2, 4}
    text = {"y": f"{new.year:04}", "m": f"{new.month:02}" if wide else str(new.month), "d": f"{new.day:02}" if wide else str(new.day)}
    sep = re.search(r"\D", m)[0]
    return sep.join(text[x] for x in order)


def new_value(kind, m):
    if kind == "secret":
        return after(re.match(r"[^=:]*[=:]\s?\"?", m).end(), m, kind)
    if kind == "key":
        return after(4, m, kind)
    if kind == "email":
        name, at, host = m.partition("@")
        return refill(name, letters(plain(name), kind)) + at + host
    if kind == "ip":
        a, b, c, d = map(int, m.split("."))
        if max(a, b, c, d) > 255:
            return None
        high, low = pair(a * 256 + b, c * 256 + d, (65536, 65536), kind)
        return ".".join(map(str, (high // 256, high % 256, low // 256, low % 256)))
    if kind == "phone":
        return after(re.match(pseudonyms._PHONE_HEAD, m, re.A).end(), m, kind)
    if kind == "card":
        p = plain(m)
        body = letters(p[:-1], kind)
        return refill(m, body + str((10 - luhn(body + "0")) % 10)) if luhn(p) == 0 else None
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        areas = [a for a in range(1, 900) if a != 666]
        high, low = pair(areas.index(area), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), kind)
        return f"{areas[high]:03}-{low // 9999 + 1:02}-{low % 9999 + 1:04}"
    if kind == "iban":
        p = plain(m)
        body = letters(p[4:], kind)
        return refill(m, p[:2] + f"{98 - rest97(body + p[:2] + '00'):02}" + body) if iban_ok(m) else None
    if kind == "iso_date":
        return date(m, "ymd")
    if "." in m:
        return date(m, "dmy")
    return date(m, "ymd") if re.match(r"\d{4}", m) else date(m, "mdy") or date(m, "dmy")


def scanned(text):
    """The text with pseudonyms and the finds per kind."""
    counts = dict.fromkeys(pseudonyms.PATTERNS, 0)
    spaced = rf"(?<!\w)(?=((?:{pseudonyms._PRINTED_IBAN})(?!\w)))"
    found = sorted({m[1] for m in re.finditer(spaced, text, re.A) if iban_ok(m[1])}, key=text.index)
    search = (rf"(?<!\w)(?:{'|'.join(found)})(?!\w)|" if found else "") + pseudonyms.ANY
    out, at = "", 0
    for m in re.finditer(search, text, re.A):
        for kind in counts:
            shape = pseudonyms._bare(kind) + (f"|{pseudonyms._PRINTED_IBAN}" if kind == "iban" else "")
            if re.fullmatch(shape, m[0], re.A):
                break
        else:
            kind = None
        new = new_value(kind, m[0]) if kind else None
        counts[kind] = counts.get(kind, 0) + (new is not None) if kind else 0
        out, at = out + text[at:m.start()] + (m[0] if new is None else new), m.end()
    counts.pop(None, None)
    return out + text[at:], counts


def drawn(turn):
    """A value of some form, often a valid one."""
    digits = lambda n: "".join(turn.choices("0123456789", k=n))
    body = digits(15)
    card = body + str((10 - luhn(body + "0")) % 10)
    account = digits(18)
    iban = f"DE{98 - rest97(account + 'DE00'):02}{account}"
    day = DAY0 + datetime.timedelta(turn.randrange(80_000))
    return turn.choice([
        card, " ".join(card[i:i + 4] for i in range(0, 16, 4)), digits(16), iban, " ".join(iban[i:i + 4] for i in range(0, 22, 4)), "DE" + digits(20),
        f"{digits(3)}-{digits(2)}-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
        f"+33 1 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{digits(11)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        ".".join(str(turn.randrange(300)) for _ in range(4)), f"a.b+{digits(3)}@mail.example.org", f"AKIA{digits(10)}QWERTZ", f'password: "Ab{digits(70)}"',
        day.isoformat(), f"{day.isoformat()}T10:00:00Z", f"{day.day}.{day.month}.{day.year}", f"{day:%d.%m.%Y}", f"{day:%m/%d/%Y}", f"{day.day}/{day.month}/{day.year}",
        f"{day:%Y/%m/%d}", "2023-02-30", "31.02.2000", digits(4), "é", "x", "and", ":", "\n"])


def compared(docs):
    got = pseudonyms.pseudonymize(docs, KEY).collect()
    for r, was in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")),
                      sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()),
                             key=lambda r: (r[0] is None, r[0] or 0, scanned(r[1] or "")[0]))):
        text, counts = (None, dict.fromkeys(pseudonyms.PATTERNS, 0)) if was[1] is None else scanned(was[1])
        assert (r.doc_id, r.text) == (was[0], text)
        assert {k: r[f"n_{k}"] for k in counts} == counts and r.n_found == sum(counts.values())
    return got


def test_drawn_values_are_those_of_plain_python(spark):
    turn = random.Random(5)
    texts = [turn.choice([" ", " ", ", ", "\n", ""]).join(drawn(turn) for _ in range(turn.randrange(1, 12))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = compared(docs)
    assert all(sum(r[f"n_{k}"] for r in got) > 20 for k in pseudonyms.PATTERNS)


def test_documents_and_odd_rows(spark, edge_docs, no_docs):
    compared(table(spark, "/root/testdata/sf0.001", "documents"))
    compared(edge_docs.withColumn("n_found", F.lit("x")).withColumn("matches", F.lit(1)).withColumn("out", F.lit(2)))
    long = "no value here, " * 20_000 + "but 2024-03-05 and a.b@mail.example.org "
    compared(spark.createDataFrame([(1, long), (1, long), (None, "ip 10.0.0.1"), (2, ""), (3, None)], "doc_id long, text string"))
    assert pseudonyms.pseudonymize(no_docs, KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pseudonyms.pseudonymize(no_docs, "")
