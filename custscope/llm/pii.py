"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, address ranges, calendar). A valid value is numbered within
the set of all valid values of its format, its number is permuted by a keyed Feistel network, and the new number is
written in the same format. The permutation depends on the key and the format only, so equal values get equal
pseudonyms in every document, different values different ones, and nothing is looked up or shuffled.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slabs

ROUNDS = 8
#: Up to this many values of a format the permutation leaves none in its place.
SMALL = 1 << 20


class Feistel:
    """A keyed permutation of 0..n-1 for any n: a Feistel network on the next square, walked until it is back below n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, number: int, half: int, modulus: int) -> int:
        data = f"{tweak}|{modulus}|{number}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest()) % modulus

    def permute(self, value: int, n: int, tweak: str) -> int:
        """The place of a value. In a small set a turn between the network and its inverse leaves no value where it was."""
        if 1 < n <= SMALL:
            return self._walk((self._walk(value, n, tweak, 1) + 1) % n, n, tweak, -1)
        return self._walk(value, n, tweak, 1)

    def _walk(self, value: int, n: int, tweak: str, way: int) -> int:
        side = 1
        while side * side < n:
            side *= 2
        # The least whole number whose square reaches n.
        low = side // 2
        while low < side:
            middle = (low + side) // 2
            if middle * middle < n:
                low = middle + 1
            else:
                side = middle
        while True:
            left, right = divmod(value, side)
            for number in range(ROUNDS)[::way]:
                if way > 0:
                    left, right = right, (left + self._round(tweak, number, right, side)) % side
                else:
                    left, right = (right - self._round(tweak, number, left, side)) % side, left
            value = left * side + right
            if value < n:
                return value


# Alphabets that are permuted within themselves.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
             "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def _spell(text: str, alphabets: list[str | None], feistel: Feistel, tweak: str) -> str:
    """Permutes all characters that have an alphabet, taken as one number in mixed radix."""
    value, n = 0, 1
    for char, alphabet in zip(text, alphabets, strict=True):
        if alphabet:
            value, n = value * len(alphabet) + alphabet.index(char), n * len(alphabet)
    if n == 1:
        return text
    value, out = feistel.permute(value, n, tweak), list(text)
    for i in range(len(text) - 1, -1, -1):
        if alphabet := alphabets[i]:
            value, digit = divmod(value, len(alphabet))
            out[i] = alphabet[digit]
    return "".join(out)


@lru_cache(1 << 12)
def _alphabet(char: str) -> str | None:
    """The letters or digits that may stand for one: a fixed alphabet, or those of its kind among the 128 code points around it."""
    for alphabet in ALPHABETS:
        if char in alphabet:
            return alphabet
    kind = unicodedata.category(char)
    if kind[0] != "L" and kind != "Nd":
        return None
    start = ord(char) & ~127
    around = "".join(c for c in map(chr, range(start, start + 128)) if unicodedata.category(c) == kind)
    return around if len(around) > 1 else ALPHABETS[1]  # a letter alone of its kind is written with a to z


def by_class(text: str, feistel: Feistel, tweak: str) -> str:
    """Every letter and digit becomes one of its own alphabet; a letter that is not in its alphabet is replaced first."""
    alphabets = [_alphabet(c) for c in text]
    plain = "".join(c if not a or c in a else a[ord(c) % len(a)] for c, a in zip(text, alphabets, strict=True))
    return _spell(plain, alphabets, feistel, tweak)


def luhn_digit(digits: str) -> str:
    """The check digit that completes a number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        double = int(c) * (2 - i % 2)
        total += double - 9 * (double > 9)
    return str(-total % 10)


def _like(digits: str, text: str) -> str:
    """Writes digits into the places of the digits of a text."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def card(text: str, feistel: Feistel) -> str | None:
    digits = re.sub("[ -]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = by_class(digits[:-1], feistel, "card")
    return _like(body + luhn_digit(body), text)


def _iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


#: Length of an IBAN by country.
IBAN_LENGTHS = {
    k: int(n) for n, names in (
        (15, "NO"), (16, "BE"), (18, "DK FK FI FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"),
        (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"),
        (24, "AD CZ DZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"),
        (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU"),
    ) for k in names.split()
}


def _iban_end(text: str) -> int | None:
    """Where the IBAN at the start of a text ends, by the length of its country."""
    left = IBAN_LENGTHS.get(text[:2])
    for at, c in enumerate(text):
        left = left and left - (c != " ")
        if left == 0:
            return at + 1
    return None


def iban(text: str, feistel: Feistel) -> str | None:
    """The value may be shorter than the text: what follows it is not part of it. Small letters stay small and count as capitals."""
    if text[:1].islower():
        fresh = iban(text.upper(), feistel)
        return fresh and fresh.lower()
    end = _iban_end(text)
    if end is None or text[end : end + 1].isalnum():
        return None
    text = text[:end]
    packed = text.replace(" ", "")
    if _iban_rest(packed) != 1:
        return None
    body = by_class(packed[4:], feistel, "iban" + packed[:2])
    fresh = f"{packed[:2]}{98 - _iban_rest(packed[:2] + '00' + body):02d}{body}"
    rest = iter(fresh)
    return "".join(c if c == " " else next(rest) for c in text)


#: Country codes of one and two digits; every other code has three.
CODES_1, CODES_2 = set("17"), set(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 "
    "93 94 95 98".split())


def phone(text: str, feistel: Feistel) -> str | None:
    """With a country code, that stays, by the table of codes; a national number is permuted as a whole.

    The value may be shorter than the text: groups at the end that make the number too long are not part of it. A
    national number without brackets has nine digits or more, so that versions, rooms and chapters are none.
    """
    digits, country = re.sub(r"\D", "", text), ""
    if text[0] == "+":
        country = digits[: 1 if digits[0] in CODES_1 else 2 if digits[:2] in CODES_2 else 3]
        digits = digits[len(country) :]
    if len(digits) > (10 if country == "1" else min(12, 15 - len(country))):
        shorter = re.sub(r"[ ./-]+\d+$", "", text)
        return phone(shorter, feistel) if shorter != text else None
    if len(digits) < (6 if text[0] in "+(" else 9):
        return None
    return _like(country + by_class(digits, feistel, "phone" + country), text)


def social(text: str, feistel: Feistel) -> str | None:
    """Area 1 to 899 without 666, group 1 to 99, serial 1 to 9999."""
    area, group, serial = map(int, text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(feistel.permute(number, 898 * 99 * 9999, "social"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(text: str, feistel: Feistel) -> str | None:
    """Four numbers, or the groups of a long address: at least three of them, with a digit, so that code is none."""
    if ":" in text:
        try:
            number = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if len([g for g in text.split(":") if g]) < 3 or not any(c.isdigit() for c in text):
            return None
        fresh = str(ipaddress.IPv6Address(feistel.permute(number, 1 << 128, "long address")))
        return fresh if text == text.lower() else fresh.upper()
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    number = feistel.permute(int.from_bytes(bytes(parts)), 1 << 32, "address")
    return ".".join(map(str, number.to_bytes(4)))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def day(text: str, feistel: Feistel) -> str | None:
    """A calendar day of 1900 to 2099, year first or last; where day and month could both be either, the day is first."""
    parts, mark = re.findall(r"\d+", text), re.search(r"\D", text)[0]
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    for order in orders:
        try:
            number = date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not _FIRST <= number <= _LAST:
            return None
        moved = date.fromordinal(_FIRST + feistel.permute(number - _FIRST, _LAST - _FIRST + 1, "day"))
        out = [""] * 3
        for i, value in zip(order, (moved.year, moved.month, moved.day), strict=True):
            out[i] = f"{value:04d}" if i == order[0] else f"{value:02d}"
        return mark.join(out)
    return None


def email(text: str, feistel: Feistel) -> str | None:
    """Local part and every label of the domain but the last; each part is keyed by itself, so domains stay linked."""
    local, _, domain = text.partition("@")
    *labels, last = domain.split(".")
    return by_class(local, feistel, "local") + "@" + ".".join([*(by_class(x, feistel, "label") for x in labels), last])


def secret(text: str, feistel: Feistel) -> str | None:
    for alphabet in (HEX_LOWER, HEX_UPPER):
        if all(c in alphabet for c in text):
            return _spell(text, [alphabet] * len(text), feistel, "secret")
    return by_class(text, feistel, "secret")


_NAMES = r"(?i:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key)"
#: Kind, pattern (the value is the whole match or its group "value"), pseudonym or None if it is not valid.
KINDS: tuple[tuple[str, str, Callable[[str, Feistel], str | None]], ...] = (
    ("secret", rf"(?<![^\W_]){_NAMES}[^\w\n]{{1,12}}(?P<value>[A-Za-z0-9_+/=-]{{16,}})", secret),
    ("email", r"[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+", email),
    ("iban", r"(?<!\w)(?:[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)|"
             r"[a-z]{2}\d{2}(?:[a-z0-9]{11,30}|(?: [a-z0-9]{4}){2,7}(?: [a-z0-9]{1,4})?))(?!\w)", iban),
    ("phone", r"(?<![\w+])(?:\+\d{7,15}|\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,8}){1,6}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|"
              r"(?<![\d.-])[2-9]\d{2}(?P<s1>[ .-])[2-9]\d{2}(?P=s1)\d{4}|"
              r"\(0\d{1,5}\)(?:[ ./-]?\d{2,8}){1,4}|(?<![\d./-])(?!\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d))0[1-9]\d{0,4}(?:[ ./-]\d{2,8}){1,4})(?!\w|[-]\d|[./]\d)", phone),
    ("social", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", social),
    ("day", r"(?<![\w./-])(?:\d{4}(?P<s0>[/.-])\d{1,2}(?P=s0)\d{1,2}|\d{1,2}(?P<s2>[./-])\d{1,2}(?P=s2)\d{4})"
            r"(?:(?=T\d{1,2}:?\d{2})|(?![\w-]|[./]\d))", day),
    ("address", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)|"
                r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", address),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|"
             r"\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?![\w-])", card),
)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_EACH = {k: re.compile(p) for k, p, _ in KINDS}
_MAKE = {k: f for k, _, f in KINDS}
#: Kinds whose value may be shorter than what the pattern took, and as long as its pseudonym.
SHORTER = ("iban", "phone")
_HINT = re.compile(r"[\d@]|" + _NAMES)
# Words that a national phone number may follow. Behind any other word it is a total, a room or the like.
PHONE_WORDS = frozenset((
    "anruf anrufen appeler appelez at au call calling cel celular cell contact dial fax fon handy is llamar llame mobil mobile móvil movil "
    "no nr number nummer numéro número oder on or ou o phone portable reach ring rufen tel tél tele telefon telefono teléfono telephone "
    "téléphone text to und unter under whatsapp").split())
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[ \t]+\Z")


def _ascii_digits(text: str) -> tuple[str, str | None]:
    """The text with digits 0 to 9, and the zero of the first digit that was of another script."""
    other = next((c for c in text if c.isdecimal() and not c.isascii()), None)
    if other is None:
        return text, None
    plain = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    return plain, chr(ord(other) - unicodedata.decimal(other))


def _fresh(kind: str, value: str, feistel: Feistel) -> str | None:
    """The pseudonym of a value, in the digits that it is written with; None if it is not valid, or nothing in it can change."""
    if kind in ("email", "secret"):
        fresh = _MAKE[kind](value, feistel)
    else:
        plain, zero = _ascii_digits(value)
        fresh = _MAKE[kind](plain, feistel)
        if fresh is not None and zero:
            fresh = "".join(chr(ord(zero) + int(c)) if c in ALPHABETS[0] else c for c in fresh)
    return None if fresh is not None and value.startswith(fresh) else fresh


def _named_otherwise(kind: str, text: str, start: int) -> bool:
    """A national phone number behind a word that speaks of something else."""
    if kind != "phone" or text[start] in "+(":
        return False
    before = _WORD_BEFORE.search(text, max(0, start - 40), start)
    return before is not None and before[1].lower() not in PHONE_WORDS
KIND_NAMES = tuple(k for k, _, _ in KINDS)


def _other(text: str, at: int, tried: str, feistel: Feistel) -> tuple[str, str, int] | None:
    """(kind, pseudonym, end) of the first later kind that is valid at a place where `tried` is not."""
    for kind in KIND_NAMES[KIND_NAMES.index(tried) + 1 :]:
        if (m := _EACH[kind].match(text, at)) and not _named_otherwise(kind, text, at) and (fresh := _fresh(kind, m[0], feistel)) is not None:
            return kind, fresh, at + len(fresh) if kind in SHORTER else m.end()
    return None


def pseudonymise(text: str, feistel: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms in place, and (kind, start, end) in the old text of each."""
    if not _HINT.search(text):
        return text, []
    parts, found, at, look = [], [], 0, 0
    while m := _ANY.search(text, look):
        kind = next(k for k in KIND_NAMES if m[k] is not None)
        group = "value" if kind == "secret" else kind
        fresh = None if _named_otherwise(kind, text, m.start()) else _fresh(kind, m[group], feistel)
        if fresh is None:
            if other := _other(text, m.start(), kind, feistel):
                kind, fresh, end = other
                start = m.start()
            else:
                look = m.start() + 1  # what is not valid may still hold a value further on
                continue
        else:
            start = m.start(group)
            end = start + len(fresh) if kind in SHORTER else m.end(group)
        parts += [text[at:start], fresh]
        at = look = end
        found.append((kind, start, end))
    return "".join([*parts, text[at:]]), found


_ADDED = "pii array<struct<kind:string,start:int,end:int>>"


def _run(key: bytes, text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch[text_at].to_pylist()
            for a, b in slabs([t or "" for t in texts]):
                done = [(None, []) if t is None else pseudonymise(t, feistel) for t in texts[a:b]]
                part = batch.slice(a, b - a)
                cols = [
                    pa.array([t for t, _ in done], pa.string()) if n == text_at else part[n] for n in part.schema.names
                ]
                found = pa.array([[dict(zip(("kind", "start", "end"), f, strict=True)) for f in fs] for _, fs in done], span)
                yield pa.RecordBatch.from_arrays([*cols, found], [*part.schema.names, "pii"])

    return run


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Whoever has the key can undo the pseudonyms: give one of your own and keep it out of the code.

    Every row with all its columns, pseudonyms in `text`, and `pii`: kind, start and end (code points) of each.

    Texts keep their length but for addresses, whose numbers have no fixed width. A null text stays null and has
    no spans, an empty one stays empty. Rows do not depend on each other; a column named pii is replaced. An
    empty table gives an empty table.
    """
    kept = docs.drop("pii")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_run(key, "text"), f"{schema}, {_ADDED}")


def _of_kind(kind: str) -> F.Column:
    return F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")


def counts() -> list[F.Column]:
    """Found values by kind."""
    return [_of_kind(k) for k in KIND_NAMES]
