"""Whole texts to ids with the tokenizers library, each distinct word encoded once per worker.

Both kinds of vocabulary that are handled here split a text at white space, and then by a pattern, before any merge,
so where a text has only plain single white space, its ids are those of its words in turn, and a word's are those of
the pattern's parts. Words and parts are kept; a part that is new goes to the library's model. A text with anything
else (runs of white space, control or unusual code points, strings of special tokens) goes to the library whole, with
nothing set but ``add_special_tokens=False``: a special token that a text spells out is that token.
"""

from __future__ import annotations

import ctypes
import json
import os
import re

import numpy as np
import pyarrow as pa

#: Distinct words kept for each worker and vocabulary, and as many parts; about 200 bytes each. When full, it starts again.
CACHE_WORDS = 800_000
#: How byte-level vocabularies split a text (a fixed value of their format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]++(?:[ \\n][!-~\u00a1-\u00ac\u00ae-\u00ff]++)*+")
_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def give_back() -> None:
    """Return freed memory to the system: workers stay between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


class Encoder:
    def __init__(self, path: str, end_id: int, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        import regex

        before, split = json.dumps(spec.get("normalizer") or {}), spec.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        if not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            self.kind, self.pattern = "space before word", regex.compile(BYTE_LEVEL)
        elif '"Regex": "\\\\s+"' in before and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed":
            self.kind, self.pattern = "space dropped", regex.compile(first["pattern"]["Regex"])
        else:
            self.kind = "whole"
        if not all("<|" in t["content"] for t in spec.get("added_tokens") or []):
            self.kind = "whole"  # other special tokens aren't looked for in plain texts
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # byte-level models write a byte as a printable code point: its own, or one from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.shown = [chr(b) if b in own else chr(next(rest)) for b in range(256)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        if part not in self.parts:
            tokens = self.tokenizer.model.tokenize("".join([self.shown[b] for b in part.encode()]))
            self.parts[part] = np.array([t.id for t in tokens], self.dtype).tobytes()
        return self.parts[part]

    def _fill(self, words: set[str]) -> None:
        if len(self.parts) > self.cache_words:
            self.parts.clear()
            give_back()
        for w in words:
            if self.kind == "space dropped":
                text = w.lower()
            else:  # "\r" marks the first word of a text, which has no space before it
                text = w[1:] if w[:1] == "\r" else w if w[:1] == "\n" else " " + w
            parts = self.pattern.findall(text)
            self.kept[w] = self._part(parts[0]) if len(parts) == 1 else b"".join(map(self._part, parts))

    def encode(self, text: str) -> bytes:
        """All ids and the end id, as little-endian integers of ``dtype``."""
        if self.kind == "whole" or "<|" in text or not _PLAIN.fullmatch(text):
            return self._library([text])[0] + self.end
        if self.kind == "space dropped":
            words = text.split()
        else:
            words = ("\r" + text).replace("\n", " \n").split(" ")
        found = list(map(self.kept.get, words))
        if None in found:
            new = {w for w, f in zip(words, found, strict=True) if f is None}
            if len(self.kept) + len(new) > self.cache_words:
                self.kept.clear()
                give_back()
                new = set(words)
            self._fill(new)
            found = map(self.kept.__getitem__, words)
        return b"".join(found) + self.end

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text or ""), self.dtype)


def encoder(path: str, end_id: int = 0, cache_words: int = CACHE_WORDS) -> Encoder:
    key = (path, end_id, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
