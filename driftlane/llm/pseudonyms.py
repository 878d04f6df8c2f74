"""Personal data replaced by format-preserving Feistel pseudonyms.

Found values are validated (Luhn for cards, octets for addresses, mod 97 for
IBANs, the calendar for dates, area rules for social security numbers), then
their variable characters are read as one number of a mixed-radix system, and
a keyed Feistel network permutes that system's whole range (cycle walking keeps
it inside). So a pseudonym has the format of its value, validity included, and
equal values get equal pseudonyms in all documents; who holds the key can turn
them back. The default key is for tests: pass a secret one.

Kinds: email, card, phone, ipv4, iban, ssn, date, and secret (access key ids,
quoted token and key values, password values, private key blocks, three-part
web tokens, personal access tokens). Four numbers after a word like `version`
are no address.

Defined cases: a null text stays null and has no spans; empty texts stay empty;
numbers that fail validation stay as they are; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import Cache

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

KINDS = ("email", "iban", "card", "phone", "ssn", "date", "ipv4", "secret")
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?![A-Za-z0-9_-])|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{8,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ipv4>(?<![\w.])(?<!(?i:version) )(?<!(?i:release) )(?<!(?i:section) )(?<!(?i:chapter) )\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
_MAYBE = re.compile(r"[0-9@]|AKIA|ASIA|PRIVATE|eyJ|gh[pousr]_|(?i:passw|pwd|secret|token|key)")


class Feistel:
    """Keyed permutations of 0..n-1 for any n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, half: int, i: int, tweak: bytes, bits: int) -> int:
        data = b"%d|%s|%x" % (i, tweak, half)
        out, block = 0, 0
        while out.bit_length() < bits + 8 and block * 512 < bits + 8:
            out = out << 512 | int.from_bytes(hashlib.blake2b(data + b"|%d" % block, key=self.key).digest(), "big")
            block += 1
        return out & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, i, tweak, bits), left
            else:
                left, right = right, left ^ self._round(right, i, tweak, bits)
        return left << bits | right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        tag = f"{tweak}|{n}".encode()
        x = self._once(x, bits, tag, back)
        while x >= n:
            x = self._once(x, bits, tag, back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
_HEX_CLASSES = ("0123456789abcdef", "0123456789ABCDEF")


def _iban_check(country: str, body: str) -> str:
    n = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(n) % 97:02d}"


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _chars(self, text: str, tweak: str, back: bool, classes=_CLASSES) -> str:
        """Permutes the text's characters of the classes, each within its class; others stay."""
        alphabets = [next((a for a in classes if c in a), None) for c in text]
        x, n = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        x = self.feistel.permute(x, n, tweak, back)
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                x, i = divmod(x, len(a))
                c = a[i]
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _refill(shape: str, characters: str) -> str:
        it = iter(characters)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def replace(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym, or None if the value isn't valid."""
        return getattr(self, f"_{kind}")(value, back)

    def _email(self, value, back):
        local, _, host = value.rpartition("@")
        return self._chars(local, "email", back) + "@" + host

    def _secret(self, value, back):
        if block := re.fullmatch(r"(-----BEGIN [A-Z ]+-----)([^-]+)(-----END [A-Z ]+-----)", value):
            return block[1] + self._chars(block[2], "secret", back) + block[3]
        if value.startswith("eyJ"):  # each part keeps its beginning, so that it still reads as such a token
            return ".".join(x[:3] + self._chars(x[3:], "secret", back) for x in value.split("."))
        at = re.search(r"[=:]\s*[\"']?", value)
        at = at.end() if at else 4
        hexed = next((_HEX_CLASSES[i : i + 1] for i, a in enumerate(_HEX_CLASSES) if set(value[at:]) <= set(a)), _CLASSES)
        return value[:at] + self._chars(value[at:], "secret", back, hexed)

    def _phone(self, value, back):
        head = re.match(r"\+\d{1,3}", value)
        at = head.end() if head else 0
        return value[:at] + self._chars(value[at:], "phone", back)

    def _card(self, value, back):
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        new = self._chars(digits[:-1], "card", back)
        return self._refill(value, new + luhn_digit(new))

    def _iban(self, value, back):
        plain = value.replace(" ", "")
        country, body = plain[:2], plain[4:]
        if _iban_check(country, body) != plain[2:4]:
            return None
        new = self._chars(body, "iban" + country, back)
        return self._refill(value, country + _iban_check(country, new) + new)

    def _ipv4(self, value, back):
        octets = value.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ipv4", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn(self, value, back):
        area, group, serial = map(int, value.split("-"))
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        x = self.feistel.permute(x, len(areas) * 99 * 9999, "ssn", back)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, value, back):
        a, sep, b, c = (m := re.match(r"(\d+)(\D)(\d+)\D(\d+)", value)).groups()
        orders = [("ymd", (a, b, c))] if len(a) == 4 else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
        for order, (y, mo, d) in orders:
            try:
                day = datetime.date(int(y), int(mo), int(d)).toordinal()
            except ValueError:
                continue
            if not _FIRST_DAY <= day <= _LAST_DAY:
                continue
            n = _LAST_DAY - _FIRST_DAY + 1
            x = self.feistel.permute(day - _FIRST_DAY, n, "date", back)
            new = datetime.date.fromordinal(_FIRST_DAY + x)
            if order == "mdy" and new.day <= 12:  # would read as day first: stays in the month-first range
                while new.day <= 12:
                    x = self.feistel.permute(x, n, "date", back)
                    new = datetime.date.fromordinal(_FIRST_DAY + x)
            form = {"ymd": f"%Y{sep}%m{sep}%d", "dmy": f"%d{sep}%m{sep}%Y", "mdy": f"%m{sep}%d{sep}%Y"}[order]
            return new.strftime(form)
        return None

    def text(self, text: str, memo: Cache | None = None, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each span of the given text."""
        if not _MAYBE.search(text):
            return text, []
        out, at, spans = [], 0, []
        for m in _PATTERN.finditer(text):
            kind = m.lastgroup
            new = memo[kind, m.group()] if memo is not None else self.replace(kind, m.group(), back)
            if new is not None:
                out += [text[at : m.start()], new]
                at = m.end()
                spans.append((kind, m.start(), m.end()))
        return "".join([*out, text[at:]]), spans


_SCHEMA = "doc_id long, text string, n_spans long, spans array<struct<kind:string,start:int,end:int>>"
_ROWS = 256


def _runner(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        memo = Cache(lambda kv: p.replace(*kv), 100_000)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts, spans = [], []
                for t in batch.column(1).to_pylist():
                    new, found = (None, []) if t is None else p.text(t, memo)
                    texts.append(new)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=["doc_id", "text", "n_spans", "spans"])

    return run


def pseudonymise(documents: DataFrame, key: bytes = b"test key: replace it") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_spans, spans (kind, start, end in the given text)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runner(key), _SCHEMA)
