"""Exact token ids of the two BPE vocabularies, at dictionary speed.

A vocabulary file in the ``tokenizers`` JSON format is loaded once per Python
worker.  Texts are cut at white space, each distinct word is encoded once per
worker by the byte-pair core of ``tiktoken`` with the file's own merge ranks,
and everything outside the plainly equivalent range of characters (combining
marks, unusual white space, scripts beyond Latin, special strings, texts of
extreme length) goes through the ``tokenizers`` library itself.  If a file's
merge order is not its id order, the library does all the work.
"""

from __future__ import annotations

import json
import re
from array import array

from mixlens.llm.common import worker_state

END = b"\xff"            # stands for the end-of-word mark: no UTF-8 text holds this byte
MAX_WORDS = 650_000      # words cached per worker before the cache starts afresh (memory bound)
LONG_TEXT = 500_000      # characters; beyond it the library encodes
LONG_WORD = 2_000        # characters; longer words are not cached

# Characters for which splitting, lower-casing and normal form agree by plain rules.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧]")

# The pre-tokenizer patterns stated in the two vocabulary files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACED = re.compile(r"\s+(?!\S)| ?\S+|\s")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others take code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    table.update({chr(256 + i): b for i, b in enumerate(rest)})
    return table


class Vocabulary:
    """One vocabulary file; ``words(text)`` cuts a text, ``ids(text)`` encodes it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        self.ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            end = bool(self.suffix) and token.endswith(self.suffix)
            core = token[:len(token) - len(self.suffix)] if end else token
            self.ranks[bytes(symbols[c] for c in core) + (END if end else b"")] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        self.plain = order == sorted(order) and self.library.normalizer is None if not self.suffix \
            else order == sorted(order)
        import regex
        import tiktoken
        ranks = dict(self.ranks)
        ranks.setdefault(END, 1 << 30)
        self.pattern = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self.coder = tiktoken.Encoding(
            "vocabulary", pat_str=WORD_PATTERN if self.suffix else BYTE_PATTERN,
            mergeable_ranks=ranks, special_tokens={})
        self.core = self.coder._core_bpe.encode_single_piece
        self.cache: dict[str, bytes] = {}

    # -- cutting -----------------------------------------------------------
    def regular(self, text: str) -> bool:
        """Whether the word-wise path provably agrees with the library."""
        return (self.plain and len(text) <= LONG_TEXT and not ODD.search(text)
                and not any(s in text for s in self.special))

    def words(self, text: str) -> list[str]:
        """The words of a regular text: white-space separated and lower-cased for
        the end-of-word vocabulary, with their leading blank for the byte-level one."""
        if self.suffix:
            return text.lower().split()
        return SPACED.findall(text)

    def word_table(self, texts: list[str]):
        """(distinct words, number of each word, word offsets of each text) of
        regular texts, cut and numbered as a whole by Arrow.  End-of-word
        vocabularies only; an empty string among the words has no ids."""
        import pyarrow as pa
        import pyarrow.compute as pc
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = cut.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy()

    # -- encoding ----------------------------------------------------------
    def word_ids(self, word: str) -> list[int]:
        if not self.suffix:
            return self.coder.encode_ordinary(word)
        if word.isalpha():                      # one pre-token
            return self.core(word.encode() + END)
        return [i for w in self.pattern.findall(word) for i in self.core(w.encode() + END)]

    def cached(self, word: str) -> bytes:
        """The ids of a word as uint32 bytes.  A letter word before one closing
        sign is looked up on its own."""
        got = self.cache.get(word)
        if got is None:
            if self.suffix and word[-1:] in ".,;:" and word[:-1].isalpha():
                return self.cached(word[:-1]) + self.cached(word[-1])
            got = array("I", self.word_ids(word)).tobytes()
            if len(word) <= LONG_WORD:
                if len(self.cache) >= MAX_WORDS:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str):
        """All ids of ``text`` as a uint32 array."""
        import numpy as np
        if not self.regular(text):
            return np.array(self.library_ids(text), dtype=np.uint32)
        if not self.suffix:
            return self.coder.encode_to_numpy(text, disallowed_special=())
        return np.frombuffer(b"".join(map(self.cached, self.words(text))), dtype=np.uint32)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of ``path``, loaded once per Python worker."""
    return worker_state(f"vocabulary:{path}", lambda: Vocabulary(path))
