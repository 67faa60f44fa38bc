"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The four base kinds follow fixed patterns (see ``base_spans``) and always stay.  The method adds:

* ``iban`` - country code, two check digits and as many characters as the country's accounts have,
  confirmed by mod-97; what follows after a space is no part of it;
* ``phone`` without ``+``, only where a context word near by raises the score to ``KEEP`` or more.

A number that fails its checksum is never added.  Every span has a score: what its kind starts with,
moved by the words near by; on base spans it is a report and decides nothing.

A null text counts as empty; null ids pass through; rows that repeat an id are rows of their own;
an empty table gives an empty result.  Offsets are code points, ends exclusive.  Every search is
linear in the text, also for very long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import table

KINDS = ("email", "ip", "card", "phone", "iban")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Characters on each side of a span in which context words count.
CONTEXT = 40
KEEP = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at the beginning of a digit run, so possessive runs find the same spans in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=[ ]?[A-Z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_REST = {n: re.compile(r"(?:[ ]?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTH.values())}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.,-])\(?0[0-9](?:[ ()./-]{0,2}[0-9]){7,13}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Context words of the four languages and what each adds to (or takes from) the score of a kind.
_WORDS = {
    "phone": (re.compile(r"\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|handy|rufnummer|téléphone|portable|teléfono|móvil)\b", re.I), re.compile(r"\b(?:order|invoice|isbn|version|ref)\b", re.I)),
    "card": (re.compile(r"\b(?:card|visa|mastercard|credit|debit|kreditkarte|karte|carte|tarjeta)\b", re.I), re.compile(r"\b(?:order|invoice|isbn|tracking|ref)\b", re.I)),
    "iban": (re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I), re.compile(r"\b(?:serial|model|ref)\b", re.I)),
    "email": (re.compile(r"\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b", re.I), re.compile(r"\b(?:example|version|npm|git)\b", re.I)),
    "ip": (re.compile(r"\b(?:ip|address|host|server|login|adresse|dirección)\b", re.I), re.compile(r"\b(?:version|release|section|chapter|kapitel)\b", re.I)),
}
#: Scores without context: confirmed by a checksum or a pattern of its own; a phone without + by neither.
_PRIOR = {"phone": 0.6, "card": 0.8, "iban": 0.9, "email": 0.8, "ip": 0.6}
LOCAL_PHONE_PRIOR = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The leftmost non-overlapping matches of each base kind that pass its test."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", begin, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def score(kind: str, text: str, start: int, end: int) -> float:
    """A span's score: its kind's prior, plus 0.4 or less 0.3 for context words near by."""
    prior = LOCAL_PHONE_PRIOR if kind == "phone" and text[start] != "+" else _PRIOR[kind]
    for_, against = _WORDS[kind]
    lo, hi = max(0, start - CONTEXT), end + CONTEXT
    near = text[lo:start] + " " + text[end:hi]
    return min(1.0, max(0.0, prior + 0.4 * bool(for_.search(near)) - 0.3 * bool(against.search(near))))


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What checksums and context add; nothing that overlaps a base span of the same kind."""
    out = []

    def free(kind: str, a: int, b: int) -> bool:
        return not any(k == kind and s < b and a < e for k, s, e in base)

    for m in _IBAN.finditer(text):
        size = IBAN_LENGTH.get(m[1])
        if size and (rest := _REST[size].match(text, m.end())) and mod97(text[m.start() : rest.end()]) and score("iban", text, m.start(), rest.end()) >= KEEP:
            out.append(("iban", m.start(), rest.end()))
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15 and free("phone", *m.span()) and score("phone", text, *m.span()) >= KEEP:
            out.append(("phone", *m.span()))
    return out


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + more_spans(text or "", base), key=lambda s: (s[1], _RANK[s[0]], s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, scores string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans, and their scores in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base, every = spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(k == "iban" for k, _, _ in every), ",".join(f"{score(k, text, a, b):.2f}" for k, a, b in every)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "scores"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(run, _OUT)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
