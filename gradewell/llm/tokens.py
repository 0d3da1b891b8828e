"""Byte-level BPE ids of whole Arrow batches.

The tokenizer's pattern never joins text across the end of a word that white space
follows, nor across most changes between letters, digits and signs, so a text is a
sequence of independent spans: such parts of words (a word's first with the one space
before it) and runs of white space. Each distinct span is given to the
library's model once; texts are put together from the results by numpy. Texts with
white space outside ASCII or the string of an added token (which is one id) go through
the library whole. Ids equal those of encoding each text whole (tests compare them).
"""

from __future__ import annotations

from array import array

import numpy as np

from gradewell.llm import kernels as K

BATCH = 4 << 20
KNOWN = 1_000_000  # distinct spans remembered between batches
WORDS = 200_000  # of their parts
NEW = 1 << 15  # new spans that are taken apart at a time
SHORT = 64  # bytes of the spans that are hashed by words of eight

# What a byte is: a space, other white space, a letter, a digit, a sign, an apostrophe (a contraction may
# follow), or something that the pattern decides on (bytes outside ASCII, control characters).
SPACE, WHITE, LETTER, DIGIT, SIGN, APOSTROPHE, OTHER = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[9:14] = WHITE
KIND[32] = SPACE
KIND[39] = APOSTROPHE
#: Whether a span starts at a byte, by the kinds of the byte before it (times 8) and its own.
CUT = np.zeros(64, bool)
for _a in range(LETTER, OTHER + 1):
    CUT[[8 * _a + SPACE, 8 * _a + WHITE, 8 * WHITE + _a]] = True
for _a, _b in ((LETTER, DIGIT), (LETTER, SIGN), (LETTER, APOSTROPHE), (DIGIT, LETTER), (DIGIT, SIGN), (DIGIT, APOSTROPHE),
               (SIGN, LETTER), (SIGN, DIGIT), (APOSTROPHE, DIGIT)):
    CUT[8 * _a + _b] = True
BLANK = np.zeros(64, bool)
BLANK[[8 * _a + _b for _a in (SPACE, WHITE) for _b in (SPACE, WHITE)]] = True
ODD = np.zeros(256, bool)  # first bytes of white space outside ASCII
ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Encoder:
    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.table = dict(enumerate(byte_symbols()))
        self.joined_table = self.table | {0: "\0"}
        self.words: dict[str, bytes] = {}  # ids (u32) of parts that several spans may have
        self._clear()

    def _clear(self):
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of the spans, ascending, and their numbers
        self.pool, self.offset = array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(symbols)]).tobytes()

    def _part(self, symbols: str) -> bytes:
        found = self.words.get(symbols)
        if found is None:
            if len(self.words) > WORDS:
                self.words.clear()
            found = self.words[symbols] = self._model(symbols)
        return found

    def _pieces(self, text: str) -> bytes:
        """Ids of a span that the pattern takes apart."""
        if not text.isascii() and max(text) > "ɏ":
            return array("I", self.whole(text)).tobytes()
        return b"".join([self._part(piece.encode().decode("latin-1").translate(self.table)) for piece in self.pieces(text)])

    def _new(self, raw: list[bytes]) -> None:
        """Add spans to what is known, in order."""
        joined = b"\0".join(raw)
        texts = joined.decode("utf-8", "replace").split("\0")
        if len(texts) == len(raw):
            symbols = joined.decode("latin-1").translate(self.joined_table).split("\0")
        else:  # spans that hold the separator
            texts = [r.decode("utf-8", "replace") for r in raw]
            symbols = [r.decode("latin-1").translate(self.table) for r in raw]
        pool, offset, tokenize = self.pool, self.offset, self.tokenize
        for text, sym in zip(texts, symbols):
            if text.isascii():
                one = text.isprintable() and "'" not in text
            else:
                one = (text[1:] if text[0] == " " else text).isalpha() and max(text) <= "ɏ"
            if one:  # for the pattern one piece
                pool.extend([t.id for t in tokenize(sym)])
            else:
                pool.frombytes(self._pieces(text))
            offset.append(len(pool))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, per-text offsets) of a string column; null is empty."""
        data, off = K.buffer(column)
        if len(self.known) > KNOWN:
            self._clear()
        start, end = _spans(data, off)
        h = _hashes(data, start, end)
        slot = _found(self.known, self.slot, h)
        raw = data.tobytes()
        new = np.flatnonzero(slot < 0)
        if len(new):
            uniq, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            number = np.arange(len(uniq)) + len(self.offset) - 1
            slot[new] = number[inverse]
            place = np.searchsorted(self.known, uniq)
            self.known, self.slot = np.insert(self.known, place, uniq), np.insert(self.slot, place, number)
            at = new[first]
            for k in range(0, len(at), NEW):
                own = at[k:k + NEW]
                self._new([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
        pool, offset = np.frombuffer(self.pool, np.uint32) if self.pool else np.zeros(0, np.uint32), np.frombuffer(self.offset, np.int64)
        count = (offset[1:] - offset[:-1])[slot]
        ids = pool[K.ragged(offset[slot], count)]
        upto = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, off)]
        odd = sorted({*_odd_space(data, off), *_holding(raw, off, self.added)})
        if len(odd):
            parts = np.split(ids, upto[1:-1])
            for i in odd:
                parts[i] = np.array(self.whole(raw[off[i]:off[i + 1]].decode("utf-8", "replace")), np.uint32)
            ids, upto = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, upto


def _found(known, slot, h):
    """The slot of each hash, -1 if it isn't known: looked for from the first known hash with the same top bits on."""
    if not len(known):
        return np.full(len(h), -1, np.int64)
    last, bits = len(known) - 1, np.uint64(64 - len(known).bit_length())
    begin = np.zeros((1 << len(known).bit_length()) + 1, np.int32)
    np.cumsum(np.bincount((known >> bits).view(np.int64), minlength=len(begin) - 1), out=begin[1:])
    at = np.minimum(begin[(h >> bits).view(np.int64)], last)
    key = known[at]
    out = np.where(key == h, slot[at], np.int32(-1)).astype(np.int64)
    rest = np.flatnonzero((key < h) & (at < last))
    at = at[rest]
    while len(rest):
        at += 1
        key, own = known[at], h[rest]
        hit = key == own
        out[rest[hit]] = slot[at[hit]]
        more = (key < own) & (at < last)
        rest, at = rest[more], at[more]
    return out


def _hashes(data, start, end):
    """Hashes of the spans, by their length and words of eight bytes; of spans over SHORT bytes by the kernel."""
    ln = end - start
    word = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    h = K.mix(ln.astype(np.uint64) * K.ORDER[0])
    left, own = ln, slice(None)
    for k in range(0, SHORT, 8):
        unused = np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)
        h[own] = K.mix((h[own] ^ (word[start[own] + k] << unused)) * K.ORDER[1])
        own = np.flatnonzero(ln > k + 8)
        if not len(own):
            break
        left = ln[own] - (k + 8)
    if len(own):
        long = np.flatnonzero(ln > SHORT)
        if len(long):
            h[long] = K.hashes(data, start, end, False)[long]
    return h


def _spans(data, off):
    """Starts and ends of the spans, which follow each other without gaps."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)  # À to ÿ are letters but for the signs × and ÷
    if len(latin):
        follow = data[latin + 1]
        latin = latin[(follow != 0x97) & (follow != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
    pair = kind.copy()
    pair[1:] |= kind[:-1] << 3
    cut = CUT[pair]
    heads = off[:-1][off[:-1] < off[1:]]
    first = np.zeros(n + 1, bool)
    first[heads] = first[n] = True
    blank = np.flatnonzero(BLANK[pair] & ~first[:-1])  # the last byte of a run goes with the word or alone
    blank = blank[~first[blank + 1]]
    cut[blank[kind[blank + 1] > WHITE]] = True
    cut[heads] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n)


def _odd_space(data, off):
    """Documents that hold white space outside ASCII."""
    rare = np.flatnonzero(ODD[data])
    if not len(rare):
        return []
    last = len(data) - 1
    x, y, z = data[rare], data[np.minimum(rare + 1, last)], data[np.minimum(rare + 2, last)]
    hit = (((x == 0xC2) & ((y == 0x85) | (y == 0xA0)))
           | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
           | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
           | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)))
    return np.unique(np.searchsorted(off, rare[hit], "right") - 1).tolist()


def _holding(raw: bytes, off, strings):
    """Documents that hold one of the strings."""
    for x in strings:
        at = raw.find(x)
        while at >= 0:
            doc = int(np.searchsorted(off, at, "right")) - 1
            inside = at + len(x) <= off[doc + 1]
            if inside:
                yield doc
            at = raw.find(x, off[doc + 1] if inside else at + 1)


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary: tasks of one worker share it and the spans it
    knows. It hangs on the library's module, as functions shipped by value have no lasting one."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_gradewell_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
