"""Token ids of whole texts by a public tokenizer, one short cache lookup per word."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

EOS = 1
CACHE_WORDS = 250_000
#: White space beside white space, or other breaks than a space and a line feed alone, is left to the tokenizer.
_UNEVEN = re.compile(r"\s\s|[^\S \n]")
#: Pieces of characters below this one have the same letters and digits in every Unicode version.
_LATER = "\u0250"
# fixed value: how byte-level vocabularies cut text before the merges
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def quick_encoder(tokenizer) -> Callable[[str], list[int]] | None:
    """An encoder of short pieces several times faster than the tokenizer's own, for plain byte-level BPE.

    There, where merges are numbered as their results are, the pair to merge next is the one
    whose result has the smallest id. None for any other kind of tokenizer.
    """
    made = json.loads(tokenizer.to_str())
    model, before = made["model"], made["pre_tokenizer"] or {}
    plain = not made["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or not plain or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    import tiktoken

    # printable bytes stand for themselves, the others for the characters from 256 on, in order
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    return tiktoken.Encoding("pieces", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordIds(dict):
    """Ids of text pieces as little-endian bytes, encoded when asked for; the first CACHE_WORDS are kept, and frequent words come early.

    Byte-level BPE vocabularies split text before the merges: one space goes with the
    word behind it and a lone line feed is a piece by itself. So a text in which white
    space stands alone is the concatenation of its pieces, each encoded by itself.
    With ``special``, the content of an added token stands for that token, as in a
    tokenizer left at its defaults; without it, it is text like any other.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.quick = quick_encoder(self.tokenizer) if sys.byteorder == "little" else None

    def __missing__(self, piece: str) -> bytes:
        if self.quick and len(piece) < 256 and max(piece, default="") < _LATER:
            ids = array(self.code, self.quick(piece)).tobytes()
        else:
            ids = self._encoded(piece)
        if len(self) < CACHE_WORDS and len(piece) < 64:
            self[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        """The tokenizer's own two steps; its encode() also builds offsets and masks that nobody reads."""
        parts = self.split(piece)
        return np.array([t.id for part, _ in parts for t in self.merge(part)], dtype=self.type).tobytes()

    def ids(self, text: str | None, end: int | None = EOS) -> np.ndarray:
        """Ids of the whole text, null as empty, and the end id behind them."""
        text = text or ""
        tail = b"" if end is None else np.array([end], dtype=self.type).tobytes()
        if any(a in text for a in self.added):
            body = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()
        elif _UNEVEN.search(text):
            body = self._encoded(text)
        else:
            body = self["\n"].join(self._line(line) for line in text.split("\n"))
        return np.frombuffer(body + tail, dtype=self.type)

    def _line(self, line: str) -> bytes:
        if not line:
            return b""
        pieces = line.replace(" ", "\x00 ").split("\x00") if "\x00" not in line else [line]
        return b"".join(map(self.__getitem__, pieces)) if pieces[0] else b"".join(map(self.__getitem__, pieces[1:]))


@functools.cache
def word_ids(path: str, special: bool = False) -> WordIds:
    return WordIds(path, special)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, found where the caller runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
