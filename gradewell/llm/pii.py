"""Personal data with offset-preserving deobfuscation (operator 8).

Base detectors find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone
numbers in the text as it stands; their patterns are written so that each scan is
linear. Texts with signs of disguise then pass two transducers that carry, for each
character they write, the source characters it came from:

* characters: zero-width ones go, full-width and other compatibility forms and the
  Latin look-alikes of Greek and Cyrillic become plain;
* phrases: "(at)", " at ... dot ", "[dot]", spaced "@", spelled digits and "plus"
  become the signs they stand for.

Detectors run again on the result and their spans go back to source characters. Spans
that overlap a base span of their kind, or hold nothing that was rewritten, are
dropped: base spans stay as they are.

Defined cases: null text is empty and has no spans; repeated rows are handled one by
one; further columns are ignored by ``find`` and kept by ``mask``; a null doc_id stays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import documents

KINDS = ("email", "ip", "card", "phone")

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting only where no digit stands before finds the same leftmost matches without
# trying every place of a long run of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                    out.append(("phone", *m.span()))
    return out


# Latin look-alikes of Cyrillic and Greek letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "З": "3", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
ODD = re.compile("[" + ZERO_WIDTH + "".join(LOOKALIKES) + "！-～①-⒛⁰-₉\U0001d400-\U0001d7ff]")
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_OPEN, _CLOSE, _S = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]", r"\s{0,3}"
_AT = rf"{_S}{_OPEN}(?:at|@|arroba){_CLOSE}{_S}"
_DOT = rf"{_S}{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}{_S}"
RULES = re.compile(
    rf"(?P<at>{_AT}|\s{{1,3}}at\s{{1,3}}(?=[a-z0-9-]{{1,63}}(?:{_DOT}|\s{{1,3}}dot\s{{1,3}})[a-z0-9])"
    rf"|(?:\s{{1,3}}@{_S}|@\s{{1,3}})(?=[a-z0-9-]{{1,63}}(?:{_DOT}|\s{{1,3}}dot\s{{1,3}}|\.)[a-z0-9]))"
    rf"|(?P<dot>{_DOT}|(?<=[a-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<digit>(?<!\w){_WORD}(?!\w))(?:[\x20,-]{{1,2}}(?=(?:{_WORD}(?!\w))|[0-9]))?"
    rf"|(?P<plus>(?<!\w)plus\s{{1,3}}(?=(?:{_WORD}(?!\w))|[0-9]))", re.I)
# The gate in front of RULES lets through every text in which they can add a span: all with
# "@" (an e-mail needs one, or a rule that writes one), a bracketed or spaced sign, "plus"
# before a number, odd characters, and a spelled digit next to another digit, as every
# number span holds four or more. All other matches of RULES rewrite words of plain prose.
BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|dot|\.|punkt|punto|point)\s{0,3}[\])}>]", re.I)
SPACED_DOT = re.compile(r"\sdot\s", re.I)
PLUS = re.compile(rf"(?<!\w)plus\s{{1,3}}(?:{_WORD}(?!\w)|[0-9])", re.I)
FOLDED = re.compile("[ſıİK]")  # equal ASCII letters where case is ignored
# Words end at all but ASCII letters and digits, so spelled digits count by their ASCII parts.
SPELLED_HASHES = np.unique(np.array([K.word_hash(x) for w in SPELLED for x in re.findall("[a-z]+", w)], np.uint64))
GAPS = np.array([not (chr(x).isascii() and chr(x).isalnum()) for x in range(256)])


def spelled(column) -> np.ndarray:
    """For each text of an Arrow column, whether a spelled digit may stand beside a digit of any kind."""
    data, off = K.buffer(column)
    s, e, h, woff = K.words(data, off, ws=GAPS)
    digit = np.isin(h, SPELLED_HASHES)
    first, last = (data[x] - np.uint8(48) < 10 for x in (s, e - 1))
    pair = np.flatnonzero(digit[1:] & (digit[:-1] | last[:-1]) | digit[:-1] & first[1:])
    doc = np.searchsorted(woff, pair, "right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[doc[pair + 1 < woff[doc + 1]]] = True
    return out


def suspicious(text: str) -> bool:
    """Whether a disguise other than spelled digits may be in the text."""
    if "@" in text or BRACKETED.search(text) or not text.isascii() and (ODD.search(text) or FOLDED.search(text)):
        return True
    low = text.lower()
    return "dot" in low and SPACED_DOT.search(text) is not None or "plus" in low and PLUS.search(text) is not None


def plain_characters(text: str):
    """(text, source place of each character, source end of each, whether rewritten)."""
    out, start, changed = [], [], []
    for i, c in enumerate(text):
        if c in ZERO_WIDTH:
            continue
        new = LOOKALIKES.get(c) or (unicodedata.normalize("NFKC", c) if ODD.match(c) else c)
        for x in new:
            out.append(x)
            start.append(i)
            changed.append(new != c)
    for k in range(1, len(out)):  # a dropped character marks the next one
        changed[k] = changed[k] or start[k] - start[k - 1] > 1
    return "".join(out), start, [s + 1 for s in start], changed


def deobfuscate(text: str):
    """The same, after the phrase rules as well."""
    if text.isascii() or not ODD.search(text):
        base, start, end, changed = text, range(len(text)), range(1, len(text) + 1), None
    else:
        base, start, end, changed = plain_characters(text)
    out, s2, e2, c2, at = [], [], [], [], 0

    def copy(a, b):
        out.append(base[a:b])
        s2.extend(start[a:b])
        e2.extend(end[a:b])
        c2.extend(changed[a:b] if changed else [False] * (b - a))
    for m in RULES.finditer(base):
        copy(at, m.start())
        sign = "@" if m["at"] else "." if m["dot"] else "+" if m["plus"] else SPELLED.get(m["digit"].lower(), "")
        last = m.end("digit") if m["digit"] else m.end()
        out.append(sign)
        s2.extend(start[m.start():m.start() + 1] * len(sign) if not isinstance(start, range) else [m.start()] * len(sign))
        e2.extend([end[last - 1]] * len(sign))
        c2.extend([True] * len(sign))
        at = m.end()
    copy(at, len(base))
    return "".join(out), s2, e2, c2


def spans(text: str, has_spelled: bool = True):
    """(base spans, added spans); has_spelled: whether spelled digits may be in the text."""
    base = detect(text)
    if not has_spelled and not suspicious(text):
        return base, []
    plain, start, end, changed = deobfuscate(text)
    added = []
    for kind, a, b in detect(plain):
        if any(changed[a:b]):
            s, e = start[a], end[b - 1]
            if not any(k == kind and s < y and x < e for k, x, y in base):
                added.append((kind, s, e))
    return base, added


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _find(batches):
    for b in K.slices(batches):
        rows = []
        for text, digits in zip(b.column("text").to_pylist(), spelled(b.column("text"))):
            base, added = spans(text or "", digits)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added]), len(added)))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, digest of the base spans, all spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                  "base_sha256 string, spans string, n_added long")


def masked(text: str, has_spelled: bool = True) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap
    are replaced together, under the kind of the first."""
    base, added = spans(text, has_spelled)
    out, at = [], 0
    for kind, a, b in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(batches):
    for b in K.slices(batches):
        i = b.schema.get_field_index("text")
        texts = zip(b.column(i).to_pylist(), spelled(b.column(i)))
        new = pa.array([None if t is None else masked(t, digits) for t, digits in texts], b.schema.field(i).type)
        yield b.set_column(i, b.schema.field(i), new)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; all other columns as they are."""
    return docs.mapInArrow(_mask, docs.schema)


def op8_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
