"""The spans that the encoder gives to the model: few, and cut only where the tokenizer's pattern cuts."""

import random

import numpy as np
import pyarrow as pa

from gradewell.llm import tokens

PARTS = ["a", "The", "word", "é", "Ünter", "naïve×2", "÷", "'s", "'ll", "'", "''", "x's", "'été", "12", "٣", "3rd", ",", ".", "--", "-'s", "'-s",
         "_", "(", "#!", " ", "  ", "\n", "\t", " \n ", "\r\n", "\x00", "\x1c", "日本", "語。", "🙂", "ɏ", "é", " ", " ", "Z" * 70,
         "q" * 8, "q" * 9, "q" * 64, "q" * 65]


def test_ids_are_those_of_whole_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(4000)] + ["", None, " ", "'", "s", "é", ",", " x"]
    enc = tokens.Encoder(tokens.default_path())
    for part in (texts[:3000], texts[3000:], texts):
        ids, off = enc.encode(pa.array(part))
        for text, a, b in zip(part, off[:-1], off[1:]):
            assert ids[a:b].tolist() == enc.whole(text or ""), text


def test_a_word_is_given_to_the_model_once_whatever_follows():
    words = [f" {a}{b}word" for a in "abcdefgh" for b in "aeiou"]
    text = "".join(w + sign for w in words for sign in (",", ".", ";", ":", "!", "?", "...", '"', ")", "1", " "))
    enc = tokens.Encoder(tokens.default_path())
    ids, _ = enc.encode(pa.array([text]))
    assert ids.tolist() == enc.whole(text)
    assert len(enc.offset) - 1 <= len(words) + 20  # nearly eleven for each word before


def test_slots_of_known_hashes():
    rng = np.random.default_rng(3)
    top = np.uint64(2**64 - 1)
    h = np.unique(np.concatenate((rng.integers(0, 2**64 - 1, 50_000, np.uint64), np.arange(3000, dtype=np.uint64), top - np.arange(3000, dtype=np.uint64))))
    for known in (h[:0], h[:1], h[-1:], h[::2], h):
        slot = rng.permutation(len(known)).astype(np.int32)
        by = dict(zip(known.tolist(), slot.tolist()))
        assert tokens._found(known, slot, h).tolist() == [by.get(x, -1) for x in h.tolist()]
