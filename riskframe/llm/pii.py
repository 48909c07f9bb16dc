"""Personal data in whole texts, disguised forms included, with spans in the source text.

The base kinds are found in the text as it is. Then small transducers write a normalised text: letters and digits
that look like ASCII ones become those, invisible characters go, spelled digits become digits, "plus" before digits
becomes +, and the spelled or bracketed forms of @ and . in something like an address become the signs. Each rewrite
keeps, for every character written, the source character it began with and the one it ended before, so a match in the
normalised text maps back to a span of the source. Matches are checked like base ones; those that no rewrite has
touched are the base matches and add nothing.

A bare "at" counts only if a spelled dot or a bracketed sign follows in the same address, which ends with a generic
label or one of two letters that is no common word; signs between blanks (`a @ b . c`) must all be so written; and spelled digits only in
runs, so that plain prose stays as it is.

Fixed values of the base kinds (leftmost, non-overlapping per kind; failing matches are dropped, no retries):
email, ip (four parts to 255), card (13 to 19 digits, Luhn), phone (+, 9 to 15 digits).

Defined results: NULL and empty texts hold nothing; repeated rows are searched each; a span is counted once even if
it is found both ways. Extra columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_texts, narrow

KINDS = ("email", "ip", "card", "phone")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Digit names in the languages at hand.
DIGIT_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

#: Cyrillic and Greek letters that look like Latin ones, in pairs.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl кk мm тt вb нh "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
    "αa οo ρp νv ιi κk υu τt ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
).split()

#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str]:
    """Single characters and the ASCII one each stands for; compatibility forms come from Unicode itself."""
    table = {ord(c): "" for c in INVISIBLE} | {ord(p[0]): p[1] for p in LOOKALIKES}
    for start, stop in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x249C), (0x24B6, 0x24EB), (0x2070, 0x208F)):
        for code in range(start, stop):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                table[code] = plain
    for code in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)):
        table[code] = str(unicodedata.digit(chr(code)))
    return table | {ord("․"): ".", ord("｡"): ".", ord("。"): ".", ord("‐"): "-", ord("‑"): "-", ord("‒"): "-", ord("–"): "-", ord(" "): " ", ord(" "): " "}


TABLE = _table()
ODD = frozenset(map(chr, TABLE))
_NAMES = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
#: A run of at least three digits, one of them spelled, with "plus" before it as a sign. One digit an item, so that there
#: is one way to read a run and a failing one costs no more than its length.
SPELLED = re.compile(
    rf"(?<![^\W_])(?:plus[\s,.-]{{1,3}})?(?:(?:{_NAMES}|[0-9])(?:[\s,.-]{{1,3}}|(?=[0-9]))){{2,}}(?:{_NAMES}|[0-9])(?![^\W_])",
    re.IGNORECASE,
)
SPELLED_ITEM = re.compile(rf"plus|{_NAMES}|[0-9]", re.IGNORECASE)
_AT = r"(?:\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?)"
_BARE_AT = r"(?:\s(?:at|arroba)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?)"
_BARE_DOT = r"(?:\s(?:dot|punkt|point|punto)\s)"
_NAME = r"[A-Za-z0-9_%+-]"
_LABEL = r"[A-Za-z0-9-]"
_ANY_DOT = rf"(?:{_DOT}|{_BARE_DOT}|\.)"
_SPACED = rf"\s@\s{_LABEL}+(?:\s\.\s{_LABEL}+)*\s\.\s(?P<end>[A-Za-z]{{2,24}})"
#: A whole run of dotted names, and the rest of an address if one follows. Names and labels are unbounded; a run without
#: an address is passed as a whole, so that each is read twice at most.
DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}+(?:{_ANY_DOT}{_NAME}+)*+"
    rf"(?P<domain>(?:{_AT}|@){_LABEL}+(?:{_ANY_DOT}{_LABEL}+)*{_ANY_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
    rf"|{_BARE_AT}{_LABEL}+(?:{_ANY_DOT}{_LABEL}+)*(?:{_DOT}|{_BARE_DOT})(?P<last>[A-Za-z]{{2,24}})(?![A-Za-z0-9])"
    rf"|{_SPACED}(?![A-Za-z0-9]))?",
    re.IGNORECASE,
)
SPACED_SIGN = re.compile(r"\s([@.])\s")
AT_SIGN = re.compile(rf"{_AT}|{_BARE_AT}", re.IGNORECASE)
DOT_SIGN = re.compile(rf"{_DOT}|{_BARE_DOT}", re.IGNORECASE)
#: Last labels that an address without any bracket or sign or with signs between blanks must end with, besides those of two letters.
LAST_LABELS = frozenset("com org net edu gov mil int info biz name dev app in us it is no be at me io ai co".split())
#: Words of two letters that prose may hold after "dot"; they end no such address.
SHORT_WORDS = frozenset("am an as by do go he hi if my of oh ok on or so to up we".split())
AT_WORDS, DOT_WORDS = frozenset({"at", "arroba"}), frozenset({"dot", "punkt", "point", "punto"})
WORDS = re.compile(r"[^\W\d_]+")
BRACKETED = re.compile(r"[\[({<]\s?(?:at|@|arroba|dot|punkt|point|punto|\.)\s?[\])}>]", re.IGNORECASE)
#: A bracketed dot makes an ip.
IP_DISGUISED = re.compile(rf"[0-9]{{1,3}}(?:{_ANY_DOT}[0-9]{{1,3}}){{3}}", re.IGNORECASE)
_PART = rf"(?:{_NAMES}|[0-9])(?:(?:[\s,-]{{1,2}}|(?=[0-9]))(?:{_NAMES}|[0-9])){{0,2}}"
#: The parts of an ip may be spelled too, also those of one digit, where a spelled or bracketed dot stands between them.
IP_SPELLED = re.compile(rf"(?<![^\W_]){_PART}(?:(?:{_DOT}|{_BARE_DOT}){_PART}){{3}}(?![^\W_])", re.IGNORECASE)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base matches in order of kind, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the leftmost match around this sign begins at its run of local letters
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if not any(map(text.__contains__, "0123456789")):
        return out
    if text.count(".") > 2:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """A text with, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace (start, end, new) ranges, in order; a new character stands for the whole range."""
        pieces, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        pieces.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        self.text, self.starts, self.ends = "".join(pieces), starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _characters(tape: Tape) -> None:
    tape.rewrite([(k, k + 1, TABLE[ord(c)]) for k, c in enumerate(tape.text) if c in ODD])


def _folded(text: str) -> str:
    """In small letters, with the letters that IGNORECASE takes for an i or s besides."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")
    return text.lower()


def _digits(tape: Tape) -> None:
    runs, parts = [m.span() for m in IP_SPELLED.finditer(tape.text)], []
    for start, end in runs:
        for dot in DOT_SIGN.finditer(tape.text, start, end):
            parts.append((start, dot.start()))
            start = dot.end()
        parts.append((start, end))
    k = 0
    for start, end in (m.span() for m in SPELLED.finditer(tape.text)):
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        if k == len(runs) or end <= runs[k][0]:
            parts.append((start, end))
    edits = []
    for start, end in sorted(parts):
        if not any(c.isalpha() for c in tape.text[start:end]):
            continue
        last = None
        for item in SPELLED_ITEM.finditer(tape.text, start, end):
            if last is not None and item.start() > last:
                edits.append((last, item.start(), ""))
            word = _folded(item[0])
            if len(word) > 1:
                edits.append((*item.span(), "+" if word == "plus" else DIGIT_NAMES[word]))
            last = item.end()
    if edits:
        tape.rewrite(edits)


def _may_end(last: str | None) -> bool:
    """Whether an address whose signs are all spelled or between blanks may end with this label; other forms have none to check."""
    if last is None:
        return True
    last = last.lower()
    return last in LAST_LABELS or (len(last) == 2 and last.isascii() and last not in SHORT_WORDS)


def _addresses(tape: Tape) -> None:
    edits = []
    for pattern in (DISGUISED, IP_DISGUISED):
        for m in pattern.finditer(tape.text):
            if pattern is DISGUISED and (m["domain"] is None or not _may_end(m["last"] or m["end"])):
                continue
            inner = [(*x.span(), ".") for x in DOT_SIGN.finditer(tape.text, *m.span())]
            if pattern is DISGUISED:
                signs = [(*x.span(), "@") for x in AT_SIGN.finditer(tape.text, *m.span())]
                inner += signs[-1:]
                inner += [(*x.span(), x[1]) for x in SPACED_SIGN.finditer(tape.text, *m.span("domain"))]
                inner.sort()
            edits += inner
    edits.sort()
    kept = []
    for e in edits:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    if kept:
        tape.rewrite(kept)


def hints(text: str) -> tuple[bool, bool]:
    """Whether an address or digits may be disguised here; a cheap look that never misses one.

    SPELLED and IP_SPELLED hold a digit name between signs or digits, so it is one of the words. Spelled digits may make
    an address possible: look again when they are written.
    """
    words = set(WORDS.findall(_folded(text)))
    address = not words.isdisjoint(AT_WORDS) and not words.isdisjoint(DOT_WORDS)
    if not address:
        bare = not words.isdisjoint(DOT_WORDS) and any(map(text.__contains__, "0123456789@"))
        bare = bare or ("@" in text and SPACED_SIGN.search(text) is not None)
        address = bare or (any(map(text.__contains__, "[({<")) and BRACKETED.search(text) is not None)
    return address, not words.isdisjoint(DIGIT_NAMES)


def added_spans(text: str) -> set[Span]:
    """Spans of disguised identifiers, in the source."""
    odd = not text.isascii() and not ODD.isdisjoint(text)
    address, digits = hints(text)
    if not (odd or address or digits):
        return set()
    tape = Tape(text)
    if odd:
        _characters(tape)
        address, digits = hints(tape.text)
    if digits:
        before = tape.text
        _digits(tape)
        address = address or (tape.text is not before and hints(tape.text)[0])
    if address:
        _addresses(tape)
    if tape.text is text:
        return set()
    return {(kind, *tape.source(a, b)) for kind, a, b in base_spans(tape.text)}


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; by kind, then start."""
    base = base_spans(text)
    more = added_spans(text)
    if not more:
        return base, base
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted({*base, *more}, key=lambda s: (order[s[0]], s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def find_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_email, n_ip, n_card, n_phone, base_sha256 and spans ("kind:start:end", comma-joined). Narrow.

    The counts are those of the base spans, as the hash; n_added counts what the method adds.
    """
    fields = [(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType())]

    def start():
        def run(part):
            out = [[] for _ in fields]
            for text in as_texts(part, text_col):
                base, every = find(text)
                row = [sum(s[0] == k for s in base) for k in KINDS]
                row += [hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return add_columns(df, text_col, fields, start, SLICE_BYTES)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in reversed(merged):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with all spans in its text replaced; columns and rows as before, NULL stays NULL."""
    columns = df.columns

    def start():
        def run(part):
            values = part.column(part.schema.get_field_index(text_col)).to_pylist()
            return [[None if t is None else mask(t, s) if (s := find(t)[1]) else t for t in values]]

        return run

    return add_columns(df, text_col, [(text_col, T.StringType())], start, SLICE_BYTES).select([F.col(f"`{c}`") for c in columns])


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_spans(narrow(spark.read.parquet(f"{sf}/documents.parquet"))).drop("text")
