"""Token counts by prefix dynamic programming.

Per document one pass stores the exact token count at every word end (offset
and running count).  A cut inside a word is resolved by the word's own prefix
table: walking its bytes, the encoding of each prefix is the encoding of a
shorter prefix plus one last token, and that token is the one whose pairing
with the previous last token byte-pair merging leaves alone.  Truncation and
budget questions are then answered from the stored counts; nothing is encoded
again.

Defined results: NULL text counts as empty (0 bytes, 0 tokens, no prefixes);
a NULL doc_id and repeated rows are carried along; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.llm.bpe import END, LONG_WORD, MAX_WORDS, vocabulary
from mixlens.llm.common import worker_state

ROWS_OUT = 512       # documents per batch handed back: bounds the batch's memory


class _Counts(dict):
    """word -> number of tokens, filled as words are met."""

    def __init__(self, vocab):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word):
        n = len(self.vocab.word_ids(word))
        if len(word) <= LONG_WORD:
            self[word] = n
        return n


def text_prefixes(vocab, text: str):
    """(ends, counts): the character offsets of all word ends of ``text`` and the
    number of tokens of the text up to each of them."""
    return batch_prefixes(vocab, [text], _Counts(vocab))[0]


def _library_prefixes(vocab, text: str):
    import numpy as np
    done = vocab.library.encode(text, add_special_tokens=False)
    if not done.ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    ends = np.fromiter((b for _, b in done.offsets), np.uint32, len(done.ids))
    words = np.array([-1 - k if w is None else w for k, w in enumerate(done.word_ids)])
    last = np.append(words[1:] != words[:-1], True)
    ends, tokens = ends[last], (np.flatnonzero(last) + 1).astype(np.uint32)
    whole = np.append(ends[1:] != ends[:-1], True)       # a character may turn into several words
    return ends[whole], tokens[whole]


def batch_prefixes(vocab, texts: list[str], known: _Counts) -> list:
    """``text_prefixes`` of many texts; their words are numbered together."""
    import numpy as np
    out = [None if vocab.regular(t) else _library_prefixes(vocab, t) for t in texts]
    plain = [k for k, o in enumerate(out) if o is None]
    if vocab.suffix:
        words, numbers, offsets = vocab.word_table([texts[k] for k in plain])
        each = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))[numbers]
        for k, a, b in zip(plain, offsets, offsets[1:]):
            point = np.frombuffer(texts[k].encode("utf-32-le"), dtype=np.uint32)
            blank = (point == 32) | (point == 10) | (point == 9) | (point == 13)
            ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
            tokens = each[a:b]
            out[k] = ends.astype(np.uint32), np.cumsum(tokens[tokens > 0], dtype=np.uint32)
        return out
    for k in plain:
        words = vocab.words(texts[k])
        each = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        out[k] = ends.astype(np.uint32), np.cumsum(each, dtype=np.uint32)
    return out


def prefix_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, and the stored prefixes
    (``prefix_ends``, ``prefix_tokens``: little-endian uint32 arrays)."""
    def run(batches):
        import pyarrow as pa
        vocab = vocabulary(vocabulary_path)
        known = worker_state(f"counts:{vocabulary_path}", lambda: _Counts(vocab))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                if len(known) > MAX_WORDS:
                    known.clear()
                size, total, ends, tokens = [], [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for text, (e, c) in zip(texts, batch_prefixes(vocab, texts, known)):
                    size.append(len(text.encode()))
                    total.append(int(c[-1]) if len(c) else 0)
                    ends.append(e.astype("<u4").tobytes())
                    tokens.append(c.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()),
                     pa.array(ends, pa.binary()), pa.array(tokens, pa.binary())],
                    names=["id", "n_bytes", "n_tokens", "prefix_ends", "prefix_tokens"])
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, prefix_ends binary, prefix_tokens binary")
            .withColumnRenamed("id", id_col))


def word_prefix_counts(vocab, piece: str) -> list[int]:
    """``counts[k]``: the tokens of ``piece[:k]`` standing alone, for every k, by
    dynamic programming over its bytes (``piece``: one pre-token)."""
    raw = piece.encode()
    ranks, core = vocab.ranks, vocab.core
    longest = max(map(len, ranks))
    alone: dict[tuple[bytes, bytes], bool] = {}

    def stays(a: bytes, b: bytes) -> bool:
        got = alone.get((a, b))
        if got is None:
            got = alone[a, b] = list(core(a + b)) == [ranks[a], ranks[b]]
        return got

    def extend(i: int, end: bytes):
        """The last token and the count of raw[:i] + end."""
        for size in range(min(i, longest), 0, -1):
            token = raw[i - size:i] + end
            if token in ranks and (size == i or stays(last[i - size], token)):
                return token, (1 if size == i else count[i - size] + 1)
        raise ValueError("no encoding: the vocabulary lacks a byte")

    last, count = [b""], [0]
    for i in range(1, len(raw) + 1):
        token, n = extend(i, b"")
        last.append(token)
        count.append(n)
    out, at = [0], 0
    for ch in piece:
        at += len(ch.encode())
        out.append(extend(at, END)[1] if vocab.suffix else count[at])
    return out


def _inside(vocab, word: str) -> list[int]:
    """Counts of all prefixes of one white-space word, from its pre-tokens' tables."""
    shown = word.lower() if vocab.suffix else word
    out, done, at = [0], 0, 0
    for m in vocab.pattern.finditer(shown):
        table = word_prefix_counts(vocab, m.group())
        out += [done] * (m.start() - at) + [done + n for n in table[1:]]
        done, at = done + table[-1], m.end()
    return out + [done] * (len(shown) - at)


def count_at(vocab, text: str, ends, tokens, cut: int) -> int:
    """The tokens of ``text[:cut]`` from its stored prefixes.  A cut inside a
    pre-token whose partial form splits otherwise (an apostrophe alone, say) is
    settled on that one word."""
    import numpy as np
    cut = min(max(cut, 0), len(text))
    k = int(np.searchsorted(ends, cut, side="right"))
    base, start = (int(tokens[k - 1]), int(ends[k - 1])) if k else (0, 0)
    rest = text[start:cut]
    if not rest or (vocab.suffix and not rest.strip()):
        return base
    if not vocab.regular(text):
        return base + len(vocab.library_ids(rest))
    whole = rest.strip() if vocab.suffix else rest
    return base + _inside(vocab, whole)[-1]


def longest_prefix(vocab, text: str, ends, tokens, budget: int) -> int:
    """Characters of the longest prefix ending at a word end, or inside the next
    word, with at most ``budget`` tokens."""
    import numpy as np
    k = int(np.searchsorted(tokens, budget, side="right"))
    start = int(ends[k - 1]) if k else 0
    if k >= len(ends):
        return len(text)
    for cut in range(int(ends[k]), start, -1):
        if count_at(vocab, text, ends[:k], tokens[:k], cut) <= budget:
            return cut
    return start


def truncate(prefixes: DataFrame, vocabulary_path: str, budget: int, text: Column | str = "text",
             alias: str = "truncated") -> DataFrame:
    """``prefixes`` joined with its texts gets the longest prefix within ``budget`` tokens."""
    @F.pandas_udf("string")
    def cut(texts, ends, tokens):
        import numpy as np
        import pandas as pd
        vocab = vocabulary(vocabulary_path)
        return pd.Series([
            None if t is None else t[:longest_prefix(vocab, t, np.frombuffer(e, "<u4"), np.frombuffer(c, "<u4"), budget)]
            for t, e, c in zip(texts, ends, tokens)], dtype=object)
    return prefixes.withColumn(alias, cut(text, "prefix_ends", "prefix_tokens"))
