"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are mapped by a keyed permutation of all values of their format, a Feistel
network that walks its cycle until it is back in the format. So a pseudonym is again a valid card, address or date, has
the same separators, and equal values get equal pseudonyms in all documents without any table that links them.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
import warnings
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ostinato.llm.rows import BLOCK_BYTES, map_rows
from ostinato.llm.storage import local, read_table

ROUNDS = 8
#: The session setting that holds the key. The example key stands in for it in tests and trials only.
KEY_SETTING = "spark.ostinato.pseudonymKey"
EXAMPLE_KEY = b"an example key, not a secret"
#: Values are numbers up to so many bits, of which half and a byte make the longest digest there is.
NUMBER_BITS = 1008
#: Characters of the longest values that a task remembers.
REMEMBERED = 256


def feistel(value: int, size: int, key: bytes, tweak: str, backward: bool = False) -> int:
    """A keyed permutation of range(size); ``backward`` undoes it."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    rounds = range(ROUNDS)[:: -1 if backward else 1]
    while True:
        left, right = value >> half, value & mask
        for i in rounds:
            seen = left if backward else right
            digest = hashlib.blake2b(f"{tweak}|{size}|{i}|{seen}".encode(), key=key[:64], digest_size=(half + 7) // 8 + 1).digest()
            mixed = int.from_bytes(digest, "big") & mask
            left, right = (right ^ mixed, left) if backward else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def other_letters(letters: list[int], size: int, key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the strings of so many letters, which are numbers below ``size``.

    A string that is too long for one number goes through a Feistel network of its two halves, whose letters are added one
    by one, in linear time.
    """
    if len(letters) * math.log2(size) > NUMBER_BITS:
        at = len(letters) // 2
        left, right = (np.array(x, np.uint8) for x in (letters[:at], letters[at:]))
        for i in range(ROUNDS):
            seed = hashlib.blake2b(f"{tweak}|{size}|{len(letters)}|{i}|".encode() + right.tobytes(), key=key[:64]).digest()
            mixed = np.frombuffer(hashlib.shake_256(seed).digest(2 * len(left)), "<u2") % size
            left, right = right, ((left + mixed) % size).astype(np.uint8)
        return [*left.tolist(), *right.tolist()]
    value, made = 0, []
    for x in letters:
        value = value * size + x
    value = feistel(value, size ** len(letters), key, tweak)
    for _ in letters:
        value, x = divmod(value, size)
        made.append(x)
    return made[::-1]


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_digit(body: str) -> str:
    """The check digit to append."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit; the first digit stays."""
    digits = digits_of(text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 2
    body = digits[0] + f"{feistel(int(digits[1:-1]), 10**n, key, 'card' + digits[0]):0{n}d}"
    return refill(text, body + luhn_digit(body))


def iban(text: str, key: bytes) -> str | None:
    """Right check digits; the country and the letters stay, digits are permuted, check digits are made anew."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
        return None
    shape, digits = plain[4:], digits_of(plain[4:])
    if not digits:
        return None
    made = refill(shape, f"{feistel(int(digits), 10 ** len(digits), key, 'iban' + plain[:2]):0{len(digits)}d}")
    checks = f"{98 - iban_number(plain[:2] + '00' + made) % 97:02d}"
    fresh = iter(plain[:2] + checks + made)
    return "".join(c if c == " " else next(fresh) for c in text)


#: Characters of an IBAN by the code of its country.
IBAN_LENGTH = {
    code: n for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for code in codes.split()
}


def iban_ends(text: str, start: int, end: int) -> list[int]:
    """Where an IBAN may end within a match that can hold words after it: at its country's length, else at any space.

    The whole match comes last where the length is known, and first where it isn't.
    """
    ends = [i for i in range(start, end) if text[i] == " "] + [end]
    if length := IBAN_LENGTH.get(text[start : start + 2]):
        return [e for e in ends if e - start - text.count(" ", start, e) == length] + [end]
    return ends[::-1]


def ssn(text: str, key: bytes) -> str | None:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at, serial = divmod(feistel(at, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(at, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def phone(text: str, key: bytes) -> str | None:
    """North American numbers keep a valid area and exchange; others with a plus sign keep their first two digits."""
    digits = digits_of(text)
    country = digits[:-10]
    if country in ("", "1") and len(digits) >= 10 and (country == "" or text.lstrip("(").startswith(("+1", "1"))):
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        if area < 200 or exchange < 200:
            return None
        at, line = divmod(feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, 800 * 800 * 10000, key, "phone"), 10000)
        area, exchange = divmod(at, 800)
        return refill(text, f"{country}{area + 200:03d}{exchange + 200:03d}{line:04d}")
    if text.startswith("+") and 9 <= len(digits) <= 15:
        n = len(digits) - 2
        return refill(text, digits[:2] + f"{feistel(int(digits[2:]), 10**n, key, 'phone' + digits[:2]):0{n}d}")
    return None


def address(text: str, key: bytes) -> str | None:
    """Four numbers of at most 255."""
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    made = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "address")
    return ".".join(map(str, made.to_bytes(4, "big")))


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def other_day(day: datetime.date, key: bytes) -> datetime.date:
    """A keyed permutation of the days of 1900 to 2099, of those up to the twelfth of a month and of the later ones apart.

    So a day has one pseudonym in all formats: in d/m/y only a number above 12 tells that the day comes first.
    """
    late, made = day.day > 12, (day - FIRST_DAY).days
    while True:
        made = feistel(made, DAYS, key, "date")
        found = FIRST_DAY + datetime.timedelta(made)
        if (found.day > 12) == late:
            return found


def date(text: str, key: bytes) -> str | None:
    """A day of 1900 to 2099 as y-m-d, d.m.y or m/d/y (d/m/y where the first number is above 12), two digits each."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", text))
    order = "ymd" if len(re.split(r"[-/.]", text)[0]) == 4 else "dmy" if "." in text or a > 12 else "mdy"
    parts = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    if not 0 <= (day - FIRST_DAY).days < DAYS:
        return None
    day = other_day(day, key)
    written = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    return re.search(r"[-/.]", text)[0].join(written[x] for x in order)


def email(text: str, key: bytes) -> str | None:
    """Letters and digits of the part before the at sign are permuted among strings of the same shape."""
    local, domain = text.rsplit("@", 1)
    tweak = f"email{re.sub('[A-Za-z0-9]', '', local)}@{domain.lower()}"
    for first, last, size in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)):
        if own := [ord(c) - ord(first) for c in local if first <= c <= last]:
            fresh = iter(other_letters(own, size, key, tweak + first))
            local = "".join(chr(ord(first) + next(fresh)) if first <= c <= last else c for c in local)
    return f"{local}@{domain}"


#: (kind, pattern, pseudonym or None where validation fails); an earlier kind wins where matches overlap.
FORMATS = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII), email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII), iban),
    ("card", re.compile(r"(?<![\d+])(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!-?\d)", re.ASCII), card),
    ("ssn", re.compile(r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?!-?\d)", re.ASCII), ssn),
    ("phone", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!-?\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){1,5}(?!\d)", re.ASCII), phone),
    ("address", re.compile(r"(?<![\d.])(?<![A-Za-z]\.)(?<!\bv)(?<!\bversion )(?<!\brelease )\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.ASCII | re.IGNORECASE), address),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![./-]?\d)", re.ASCII), date),
]
DIGIT = re.compile(r"\d", re.ASCII)


def pseudonymiser(key: bytes):
    """A function from a text to its pseudonymised text and the (start, end, kind) of what it replaced."""

    def pseudonym(k: int, value: str) -> str | None:
        return FORMATS[k][2](value, key)

    cached = lru_cache(1 << 16)(pseudonym)

    def replace(text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        if not text or not (DIGIT.search(text) or "@" in text):
            return text, []
        found, taken = [], bytearray(len(text))
        for k, (kind, pattern, _) in enumerate(FORMATS):
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                start, at = m.start(), m.end()
                for end in iban_ends(text, start, at) if kind == "iban" else [at]:
                    if taken.find(1, start, end) < 0 and (made := (cached if end - start <= REMEMBERED else pseudonym)(k, text[start:end])) is not None:
                        found.append((start, end, kind, made))
                        taken[start:end] = b"\1" * (end - start)
                        at = end
                        break
                else:
                    if kind == "iban":  # Another one may begin within.
                        at = start + 1
        found.sort()
        parts, at = [], 0
        for a, b, _, made in found:
            parts += [text[at:a], made]
            at = b
        return "".join(parts) + text[at:], [x[:3] for x in found]

    return replace


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the text with pseudonyms, n_found, and spans (kind:start:end in code points of the text as it was).

    A null text stays null and has no spans; an empty one stays empty. Equal texts give equal rows, repeated rows are
    kept, an empty table gives an empty one; other columns aren't read.
    """

    def step():
        replace = pseudonymiser(key)

        def call(batch: dict[str, list]) -> dict[str, list]:
            made = [replace(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "text": [m[0] for m in made], "n_found": [len(m[1]) for m in made], "spans": [",".join(f"{k}:{a}:{b}" for a, b, k in m[1]) for m in made]}

        return call

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, text string, n_found long, spans string", BLOCK_BYTES)


@cache
def own_key() -> bytes:
    """A random key of this process, the same for all its queries; no setting or file gets it."""
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names. Without one, the published example key stands in in a local session only.

    On a cluster a random key does, which isn't kept: nobody can undo its pseudonyms afterwards, and those of another
    application don't agree with them.
    """
    if named := spark.conf.get(KEY_SETTING, None):
        return named.encode()
    if local(spark):
        return EXAMPLE_KEY
    warnings.warn(f"{KEY_SETTING} isn't set: a random key is used, so pseudonyms agree within this application only", stacklevel=2)
    return own_key()


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, by the session's key."""
    return pseudonymise(read_table(spark, sf_dir, "documents"), session_key(spark))
