"""Ids of texts that hold an added token's string against a fresh tokenizer of the library."""
import pyarrow as pa
from tokenizers import Tokenizer

from gradewell.llm import tokens

from .conftest import prose


def test_added_tokens_are_one_id():
    path = tokens.default_path()
    fresh, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"{prose(1, 30)}{end}\n\n{prose(2, 30)} {end} ", "<|endof", "text|>", None, f" {end}", "<|endoftext|", ">",
             f"é{end}漢", f"<|{end}|>", "plain"]
    for _ in range(2):
        for column in (pa.array(texts), pa.array(texts[3:]).slice(2)):
            ids, off = enc.encode(column)
            for i, t in enumerate(column.to_pylist()):
                assert ids[off[i]:off[i + 1]].tolist() == fresh.encode(t or "", add_special_tokens=False).ids, t
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
