"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus-signs, digits, schemes
and identifier cues. From each anchor a small deterministic parser expands to the boundaries
of an address, account or number and validates it. Four kinds (email, ip, card, phone) are
the leftmost non-overlapping matches of fixed patterns; the parsers give exactly these. The
other kinds are added: url by its scheme, iban by country and check digits, account and secret
by cues in any case, standing as words of their own, and a value that holds a digit. No span
is cut short; each parser's scans are disjoint, so the time is linear in the text.

Rows are read, scanned and returned where they lie: no shuffle, nothing grouped, nothing
broadcast, so neither hot keys nor long texts matter to any other row.

Defined results: a null or empty text has no spans (its digest is that of an empty string);
repeated rows give repeated results; an empty table gives no rows; a null doc_id is kept;
extra columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

# What an address or number may consist of.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
REST_OF_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
CUED_IBAN = re.compile(r"\W{0,3}(?:(?:no|nr|number)\b\W{0,3})?(?=[A-Z]{2}[0-9]{2})", re.I)
GAP = re.compile(r"(?:\s?(?:no|nr|number|id)\b\.?)?\s?[:=#]?\s?[\"']?", re.I)
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+.-]{5,}")
IBAN_LENGTHS = dict(
    AD=24, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19, SK=24, SM=27
)
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def lowered(text: str) -> str:
    """In small letters, each sign at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", ("iban",))):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


class Finder:
    """Spans (start, kind, end) of one text."""

    def __init__(self):
        self.automaton = anchors()

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        out: list[tuple[int, str, int]] = []
        done = dict.fromkeys(KINDS, 0)  # up to where each kind has been decided
        for end, (anchor, size) in self.automaton.iter(lowered(text)):
            at = end - size + 1
            if anchor == "digit":
                if at >= done["ip"]:
                    self.ip(text, at, done, out)
                if at >= done["card"]:
                    self.card(text, at, done, out)
                if at >= done["iban"] and at > 1 and "A" <= text[at - 1] <= "Z":
                    self.iban(text, at, done, out)
            elif anchor in ("account", "secret", "iban"):
                self.cued(anchor, text, at, end + 1, done, out)
            else:
                getattr(self, anchor)(text, at, done, out)
        return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))

    def ip(self, text, at, done, out):
        if m := IP.match(text, at):
            done["ip"] = m.end()
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((at, "ip", m.end()))
        else:
            done["ip"] = DIGITS.match(text, at).end()

    def card(self, text, at, done, out):
        if m := CARD.match(text, at):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((at, "card", m.end()))
        else:
            done["card"] = at + 1

    def plus(self, text, at, done, out):
        if m := PHONE.match(text, at):
            done["phone"] = m.end()
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((at, "phone", m.end()))

    def at(self, text, at, done, out):
        start = at
        while start > done["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done["email"] = m.end()
            out.append((start, "email", m.end()))

    def scheme(self, text, at, done, out):
        start = at
        while start > done["url"] and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        if start < at and (m := REST_OF_URL.match(text, at + 3)):
            done["url"] = m.end()
            end = at + 3 + len(m[0].rstrip(".,;:!?)]"))
            if end > at + 3:
                out.append((start, "url", end))

    def iban(self, text, at, done, out):
        """The digit at `at` may be the first check digit of an account number of a known country."""
        start = at - 2
        want = IBAN_LENGTHS.get(text[start:at])
        if want and not text[start - 1 : start].isalnum() and (m := IBAN.match(text, start)):
            self.iban_of(m, want, done, out)

    def iban_of(self, m, want, done, out):
        """Ends of the match at which it has the wanted length (any, if None) and its check digits are right; the longest counts."""
        for end in range(m.end(), m.start(), -1):
            found = m.string[m.start() : end]
            n = len(found) - found.count(" ")
            if n < (want or 15):
                return
            if found[-1] != " " and n == (want or n) and not m.string[end : end + 1].isalnum() and iban_ok(found):
                done["iban"] = end
                out.append((m.start(), "iban", end))
                return

    def cued(self, kind, text, at, end, done, out):
        """A value after a cue that is a word of its own (or a part set off by other than letters and digits)."""
        if end < done[kind] or text[at - 1 : at].isalnum() or text[end : end + 1].isalnum():
            return
        if kind == "iban":
            if (m := CUED_IBAN.match(text, end)) and (m := IBAN.match(text, m.end())) and m.start() >= done["iban"]:
                self.iban_of(m, IBAN_LENGTHS.get(m[0][:2]), done, out)
            return
        start = GAP.match(text, end).end()
        if start == end or not (m := VALUE.match(text, start)):
            return
        if any(c.isdigit() for c in m[0]):
            out.append((start, kind, m.end()))
            done[kind] = m.end()
        elif len(m[0]) > 64:  # cues within it would find the same end and no digit either
            done[kind] = m.end()


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the four fixed kinds, their digest, and all spans as kind:start:end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                spans = finder.spans(text.as_py() or "")
                kinds = [k for _, k, _ in spans]
                shown = [f"{k}:{s}:{e}" for s, k, e in spans]
                base = ",".join(x for x, k in zip(shown, kinds, strict=True) if ORDER[k] < len(BASE_KINDS))
                rows.append((doc_id, *(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(shown), len(spans)))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
