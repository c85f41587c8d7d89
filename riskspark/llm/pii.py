"""PII with offset-preserving deobfuscation.

Identifiers are first found in the text as it is (the base spans).  Then transducers
rewrite disguises: homoglyphs and foreign digits become ASCII, spelled digits become
digits, "(at)" and "dot" become signs.  Every character of the rewritten text knows the
stretch of source characters it came from.  The same detectors run on the rewritten
text, and what they find through a rewritten character is mapped back to source offsets
and added.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# FIXED VALUES: what the detectors look for.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Only a whole run of digits can stand before a dot, so a search need not start inside one.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)

# FIXED VALUES: letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-",
}

# FIXED VALUES: digit words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
# Spelled digits in a row that are read as a number; fewer stay words.
LEAST_SPELLED = 7

_digit_word = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]+)?{_digit_word}(?:[\s,-]+{_digit_word}){{{LEAST_SPELLED - 1},}}(?!\w)")
ONE_SPELLED = re.compile(rf"plus|{_digit_word}")
WRAPPED_AT = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*"
WRAPPED_DOT = r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*"
WRAPPED = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]")
# AT label DOT label ... behind a name, with at least one sign in disguise; plain " at " only where a dot is spelled too
DISGUISED = re.compile(
    rf"(?<=[a-z0-9._%+-])(?P<at>{WRAPPED_AT}|@|\s+at\s+)(?P<domain>[a-z0-9-]+(?:(?:{WRAPPED_DOT}|\s+dot\s+|\.)[a-z0-9-]+)+)")
DOT = re.compile(rf"{WRAPPED_DOT}|\s+dot\s+")
DISGUISED_ADDRESS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{WRAPPED_DOT}|\s+dot\s+|\.)[0-9]{{1,3}}){{3}}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain; a search from each @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            found.append((at - local, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    return [m.span() for m in ADDRESS.finditer(text) if all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))]


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= sum(map(str.isdigit, m[0])) <= PHONE_DIGITS[1]]


DETECTORS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: DETECTORS[kind](text) for kind in KINDS}


@cache
def homoglyphs() -> tuple[dict[int, str], re.Pattern]:
    """The character transducer: one source character for one ASCII character."""
    table = {ord(k): v for k, v in LOOKALIKES.items()} | {
        ord(k.upper()): v.upper() for k, v in LOOKALIKES.items() if len(k.upper()) == 1}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for c in range(0x80, 0x20000):
        digit = unicodedata.decimal(chr(c), None)
        if digit is not None:
            table[c] = str(digit)
    low = "".join(re.escape(chr(c)) for c in sorted(table) if c < 0x10000)
    return table, re.compile(f"[{low}\U00010000-\U0001FFFF]")


def rewrite(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text without disguises, and for each of its characters the source start and
    end; None if nothing is disguised."""
    table, glyph = homoglyphs()
    plain = text.translate(table) if glyph.search(text) else text
    # One character for one also here: lower() may lengthen a text, ASCII letters never do.
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    edits: list[tuple[int, int, str]] = []
    if " dot " in low or WRAPPED.search(low):
        free = 0
        for m in DISGUISED.finditer(low):
            # a name of its own, no end of the domain before
            if m.start() <= free:
                continue
            free = m.end()
            dots = list(DOT.finditer(low, m.start("domain"), m.end("domain")))
            wrapped = m["at"] != "@" and not m["at"].isspace() and m["at"].strip() != "at"
            if m["at"] == "@" and not dots or m["at"].strip() == "at" and not dots:
                continue
            if m["at"] != "@" and (wrapped or dots):
                edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in dots]
        for m in DISGUISED_ADDRESS.finditer(low):
            edits += [(*d.span(), ".") for d in DOT.finditer(low, *m.span())]
    for m in SPELLED.finditer(low):
        at = m.start()
        for word in ONE_SPELLED.finditer(low, *m.span()):
            edits.append((at, word.end(), "+" if word[0] == "plus" else DIGIT_WORDS[word[0]]))
            at = word.end()
    if not edits and plain is text:
        return None
    out, starts, ends, at = [], [], [], 0
    for a, b, new in sorted(set(edits)):
        if a < at:
            continue
        out.append(plain[at:a])
        starts += range(at, a)
        ends += range(at + 1, a + 1)
        out.append(new)
        starts.append(a)
        ends.append(b)
        at = b
    out.append(plain[at:])
    starts += range(at, len(plain))
    ends += range(at + 1, len(plain) + 1)
    return "".join(out), starts, ends


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans, in source offsets, that only the rewritten text shows.  One that overlaps a
    base span of its kind is left out."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    rewritten = rewrite(text)
    if rewritten is None:
        return found
    plain, starts, ends = rewritten
    for kind in KINDS:
        taken = sorted(base[kind])
        for a, b in DETECTORS[kind](plain):
            source = (starts[a], ends[b - 1])
            # leading blanks of a rewritten stretch are no part of an identifier
            while text[source[0]].isspace():
                source = (source[0] + 1, source[1])
            if text[source[0]:source[1]] != plain[a:b] and not any(x < source[1] and source[0] < y for x, y in taken):
                found[kind].append(source)
    return found


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id; n_email, n_ip, n_card, n_phone (base spans);
    base_sha256; spans (base and added, ``kind:start:end``); n_added.

    A null or empty text has no spans; repeated rows each get a result; an empty table
    gives none; other columns are not read.  Offsets count code points, ends exclusive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, digests, spans, added = [], [], [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base)
                counts.append([len(base[kind]) for kind in KINDS])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written({kind: base[kind] + more[kind] for kind in KINDS}))
                added.append(sum(map(len, more.values())))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"])

    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "n_added long")
    return map_arrow(id_and_text(docs, id_col, text_col), run, schema)
