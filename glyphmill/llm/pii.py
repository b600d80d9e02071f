"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates that pass their format's own check, and e-mail addresses, are permuted within the set of values of
their format, so that they stay valid, and equal values get equal pseudonyms in every document: payment cards (Luhn),
IBANs (mod 97), IPv4 addresses, phone numbers with country code or brackets, US social security numbers, ISO, dotted
and slashed dates, and the local part of e-mail addresses. No value is left as it was: the permutation is a keyed
Feistel network around a step by one. With the key, restored() undoes it. All forms of a date get one new date, and phone
numbers differ by country code, number of digits and digits only, not by how they are written.

A null text stays null, an empty one empty; repeated rows are treated alike; other columns stay as they are, but for
n_<kind> columns, which are replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: For op6_pii and where the session names no other key. It is public: with it anyone can undo the pseudonyms.
DEMONSTRATION_KEY, KEY_SETTING, ROUNDS = b"replace this key in production", "spark.glyphmill.pii.key", 10
KINDS = ("card", "iban", "ip", "phone", "ssn", "date", "email")
FOUND = re.compile(
    r"""(?<![\w.+-])(?P<date>\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w/-]|\.\d)
    |(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)
    |(?<![\w-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w-])
    |(?<![\w+])(?P<card>\d{13,19}|\d{4}([ -])\d{4}\5\d{4}\5\d{4}|\d{4}([ -])\d{6}\6\d{5})(?!\w)
    |(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\w)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{1,4}){2,8}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4})(?!\w)
    |(?<!\w)(?P<iban>[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)""",
    re.VERBOSE | re.ASCII,
)
#: What any of the above begins with; texts without it, and their parts without a digit, are passed over.
DIGIT, MAIL = re.compile(r"[0-9]"), re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w-])", re.ASCII)
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of range(n) without fixed points, for each name and n."""

    def __init__(self, key: bytes):
        self.key, self.back, self.late = key, False, None

    def days(self, late: bool) -> tuple[list[int], dict[int, int]]:
        """Ordinals of the days after the 12th of their month, which month/day order can write too, or of the others, and their places."""
        if self.late is None:
            both: tuple[list[int], list[int]] = [], []
            for n in range(FIRST_DAY, LAST_DAY + 1):
                both[datetime.date.fromordinal(n).day > 12].append(n)
            self.late = [(days, {n: k for k, n in enumerate(days)}) for days in both]
        return self.late[late]

    def round(self, name: str, n: int, step: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{name}/{n}/{step}/{value}".encode(), key=hashlib.sha256(self.key).digest(), digest_size=32).digest(), "big")

    def feistel(self, name: str, n: int, value: int, back: bool) -> int:
        """One pass over the least a * b that holds n, as often as it takes to come back below n."""
        a = int(n**0.5) + 1 if n < 1 << 40 else 1 << (n.bit_length() + 1) // 2
        b = -(-n // a)
        while True:
            left, right = value // b, value % b  # left < a, right < b
            for step in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if step % 2:
                    right = (right + (-1 if back else 1) * self.round(name, n, step, left)) % b
                else:
                    left = (left + (-1 if back else 1) * self.round(name, n, step, right)) % a
            value = left * b + right
            if value < n:
                return value

    def __call__(self, name: str, n: int, value: int) -> int:
        if n < 2:
            return value
        return self.feistel(name, n, (self.feistel(name, n, value, False) + (-1 if self.back else 1)) % n, True)


def refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that follows these."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def card(text: str, p: Permutation) -> str | None:
    d = re.sub(r"\D", "", text)
    if int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
        return None
    body = d[0] + str(p("card", 10 ** (len(d) - 2), int(d[1:-1]))).zfill(len(d) - 2)
    return refill(text, body + str(luhn(body)))


def classes(text: str, p: Permutation, name: str) -> str:
    """Each letter for a letter, each digit for a digit; others stay."""
    n, value, sizes = 1, 0, []
    for c in text:
        base, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c.upper()) - 65) if c.isalpha() else (1, 0)
        n, value = n * base, value * base + at
        sizes.append(base)
    value, out = p(f"{name}/{''.join('d' if s == 10 else 'a' if s == 26 else c for s, c in zip(sizes, text, strict=True))}", n, value), []
    for base, c in zip(reversed(sizes), reversed(text), strict=True):
        value, at = divmod(value, base)
        out.append(chr(48 + at) if base == 10 else chr((97 if c.islower() else 65) + at) if base == 26 else c)
    return "".join(reversed(out))


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def own_length(text: str) -> int | None:
    """Where an IBAN of its country's length ends in text, if a group ends there."""
    left = IBAN_LENGTH.get(text[:2], 0)
    for k, c in enumerate(text):
        left -= c != " "
        if not left:
            return k + 1 if text[k + 1 : k + 2] in ("", " ") else None
    return None


def valid_iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and mod97(s[4:] + s[:4]) == 1


def iban(text: str, p: Permutation) -> str | None:
    """The pseudonym of the IBAN of its country's length that text begins with, or else of the whole text."""
    end = own_length(text)
    if end and valid_iban(text[:end]):
        return new_iban(text[:end], p)
    if not valid_iban(text):
        return None
    new = new_iban(text, p)
    while end and end < len(text) and valid_iban(new[:end]):  # restored() would take the shorter one
        new = new_iban(new, p)
    return new


def new_iban(text: str, p: Permutation) -> str:
    s = text.replace(" ", "")
    body = classes(s[4:], p, f"iban/{s[:2]}")
    rest = iter(s[:2] + f"{98 - mod97(body + s[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(rest) for c in text)


def ip(text: str, p: Permutation) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(str(n) != x for n, x in zip(parts, text.split("."), strict=True)):
        return None
    value = int.from_bytes(bytes(parts), "big")
    low, high = next((a << 24, b << 24) for a, b in ((0, 1), (1, 224), (224, 256)) if a <= parts[0] < b)
    return ".".join(map(str, (low + p("ip", high - low, value - low)).to_bytes(4, "big")))


def phone(text: str, p: Permutation) -> str | None:
    d = re.sub(r"\D", "", text)
    while len(d) > 15 and (cut := re.match(r"(.*\d)[ .-]\d+$", text)):  # numbers that follow it
        text = cut[1]
        d = re.sub(r"\D", "", text)
    if not 9 <= len(d) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})(?=\D)|\+(1(?=\d{10}$)|\d\d)|", re.sub(r"(?<=\d)[.-](?=\d)", " ", text))
    kept = (code[1] or code[2] or "") if code else ""
    rest = d[len(kept) :]
    code = kept or "1"  # numbers in brackets without a country code are those of code 1
    return refill(text, kept + str(p(f"phone/{code}/{len(rest)}", 10 ** len(rest), int(rest))).zfill(len(rest)))


def ssn(text: str, p: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(p("ssn", 898 * 99 * 9999, value), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def date(text: str, p: Permutation) -> str | None:
    sep = "-" if "-" in text else "/" if "/" in text else "."
    a, b, c = map(int, text.split(sep))
    month_first = sep == "/" and b > 12
    year, month, day = (a, b, c) if sep == "-" else (c, a, b) if month_first else (c, b, a)
    try:
        at = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at <= LAST_DAY:
        return None
    days, place = p.days(datetime.date.fromordinal(at).day > 12)  # either kind among itself, so that all forms of a date stay one
    new = datetime.date.fromordinal(days[p(f"date/{len(days)}", len(days), place[at])])
    if sep == "-":
        return new.isoformat()
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    wide = len(text) == 10
    return f"{first:02d}{sep}{second:02d}{sep}{new.year}" if wide else f"{first}{sep}{second}{sep}{new.year}"


MAKE: dict[str, Callable[[str, Permutation], str | None]] = {"card": card, "iban": iban, "ip": ip, "phone": phone, "ssn": ssn, "date": date}


def pseudonymised(text: str, p: Permutation) -> tuple[str, dict[str, int]]:
    """text with pseudonyms, and how many values of each kind it had."""
    seen = dict.fromkeys(KINDS, 0)

    def numbers(text: str) -> str:
        out, at = [], 0
        while m := FOUND.search(text, at):
            kind, end = m.lastgroup, m.end()
            new = MAKE[kind](m[0], p)
            if new is not None:
                seen[kind] += 1
                if kind in ("iban", "phone"):
                    end = m.start() + len(new)  # less than the match if only its beginning is a value
            out += [text[at : m.start()], m[0] if new is None else new]
            at = end
        return "".join([*out, text[at:]])

    def mail(m: re.Match) -> str:
        new = classes(m[1], p, f"email/{m[2].lower()}")
        if new == m[1]:  # it has neither letter nor digit
            return m[0]
        seen["email"] += 1
        return f"{new}@{m[2]}"

    if "@" in text:
        parts = MAIL.split(text)
        if len(parts) > 1:
            out = [numbers(parts[0])]
            for m, rest in zip(MAIL.finditer(text), parts[3::3], strict=True):
                out += [mail(m), numbers(rest)]
            return "".join(out), seen
    return (numbers(text) if DIGIT.search(text) else text), seen


def replaced(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with pseudonyms in text, and n_<kind> after its columns."""
    names = [n for n in docs.columns if n not in {f"n_{k}" for k in KINDS}]
    column = names.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        p.back = back
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for value in batch.column(column):
                text, seen = (None, dict.fromkeys(KINDS, 0)) if (raw := value.as_py()) is None else pseudonymised(raw, p)
                texts.append(text)
                for k in KINDS:
                    counts[k].append(seen[k])
            columns = list(batch.columns)
            columns[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int32()) for k in KINDS)], names=[*names, *(f"n_{k}" for k in KINDS)])

    rows = docs.select(*[f"`{n}`" for n in names])
    return rows.mapInArrow(make, ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"n_{k} int" for k in KINDS]))


def restored(docs: DataFrame, key: bytes) -> DataFrame:
    """docs as before replaced() with this key."""
    return replaced(docs, key, back=True)


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting KEY_SETTING, or the demonstration key."""
    return (spark.conf.get(KEY_SETTING, None) or DEMONSTRATION_KEY.decode()).encode()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return out.withColumn("n_values", total).withColumn("text_sha256", F.sha2("text", 256))
