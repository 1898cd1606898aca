"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from veinwork.llm.spans import Span, scan_spans

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "birth", "passport", "account")
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: had the run's start not matched, its rest would not either.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Where an IBAN may begin, and how it may go on; ends are tried by _ibans.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
# Lengths of IBANs by country; for a country that isn't here every length from 15 to 34 is tried.
_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY HU LB PL", 29: "BR QA UA", 30: "JO KW", 31: "MT",
}.items() for c in cs.split()}
_GOES_ON = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

_BIRTH = re.compile(r"(?<![0-9./-])(?:[0-3]?[0-9]([./-])[01]?[0-9]\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9]|[./-][0-9])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9.,+-])[0-9]{8,12}(?![A-Za-z0-9]|[.,-][0-9])")

# Words that make a kind likelier when they stand near, words that make it less likely, and the reach in characters.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "birth": ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"),
    "passport": ("passport", "passeport", "pass", "reisepass", "pasaporte"),
    "account": ("account", "konto", "kontonummer", "compte", "cuenta"),
}
AGAINST = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section", "chapter", "v"),
    "card": ("isbn", "order", "tracking", "serial", "invoice"),
    "phone": ("isbn", "serial", "score"),
    "iban": ("serial",),
    "ssn": ("part", "serial", "model"),
    "birth": ("published", "released", "updated", "due"),
    "passport": ("part", "serial", "model"),
    "account": ("order", "serial", "invoice", "isbn"),
}
PRIOR = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.35, "birth": 0.3, "passport": 0.3, "account": 0.3}
REACH, NEAR_BONUS, FAR_MALUS, LEAST = 40, 0.25, 0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> list[tuple[int, int]]:
    """Of each start the end at its country's length, or else the longest, that stands at a boundary and passes mod 97;
    at most 34 characters are tried, so linear."""
    found, done = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        size, ends, want = 4, [], _LENGTHS.get(m[0][:2])
        for at in range(m.start(1), m.end(1)):
            if text[at] != " ":
                size += 1
                if (size == want if want else size >= 15) and not _GOES_ON.match(text, at + 1):
                    ends.append(at + 1)
        end = next((e for e in reversed(ends) if mod97(text[m.start() : e].replace(" ", ""))), None)
        if end:
            found.append((m.start(), end))
            done = end
    return found


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: linear however long a run of letters is."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return found


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find_pii(text: str) -> list[Span]:
    """All spans by start, then kind. The base kinds stand once their checks hold; the added ones need a score."""
    found: list[tuple[str, int, int]] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    found += [("iban", *s) for s in _ibans(text)]
    if "-" in text:
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    found += [("birth", *m.span()) for m in _BIRTH.finditer(text) if _date(m[0])]
    found += [(kind, *m.span()) for kind, p in (("passport", _PASSPORT), ("account", _ACCOUNT)) for m in p.finditer(text)]
    found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in found]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= LEAST]


def _date(text: str) -> bool:
    parts = [int(p) for p in re.split(r"[./-]", text)]
    year, month, day = parts if parts[0] > 31 else parts[::-1]
    return 1 <= month <= 12 and 1 <= day <= 31 or 1 <= day <= 12 and 1 <= month <= 31


def score(text: str, kind: str, start: int, end: int) -> float:
    """How likely a span of this kind is personal data: its prior, more with a word of CONTEXT within REACH characters,
    less with one of AGAINST; between 0 and 1."""
    near = set(re.findall(r"\w+", f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()))
    changed = PRIOR[kind] + NEAR_BONUS * any(w in near for w in CONTEXT[kind]) - FAR_MALUS * any(w in near for w in AGAINST[kind])
    return round(min(1.0, max(0.0, changed)), 4)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans(kind, start, end, score) of each row, found in the whole text.

    Checksums (Luhn, mod 97) and ranges confirm what patterns propose. Words nearby raise or lower each span's score: the base
    kinds always stay, with their scores; of the others those stay that reach LEAST, most of them only near a word of their kind.
    A null text counts as empty and has no spans; each row is scanned by itself, so repeated rows, ties and
    empty tables need nothing special. Every search is linear in the text's length. Other columns are ignored.
    """
    return scan_spans(docs, find_pii, id_col, text_col)
