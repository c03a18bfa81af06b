"""BPE encoding and decoding through a table of distinct words.

Texts are cut into words that byte-pair merging never crosses (runs between
blanks, with their leading blank; other pre-tokens where a text is irregular).
Texts are dealt into chunks of bounded size; a chunk names its distinct words
and sends them, dealt by hash, to the task that owns that part of the word
table.  There each distinct word is encoded once.  The ids go back to the
chunks and are joined to the words of each document by position.  Decoding
joins ids to pieces through the id-to-piece table, which is bounded by the
vocabulary and travels with the task.  The texts are shuffled once, compressed
in groups, and the distinct words of each chunk twice, as compressed blocks.

Defined results: NULL text counts as empty (no ids, empty decoded text); a
NULL doc_id and repeated rows are carried along; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm.bpe import MAX_WORDS, SPACED, vocabulary
from mixlens.llm.common import size_units, worker_state

CHUNK_BYTES = 12 << 20     # text bytes of one chunk, about
OWNERS = 1024              # parts of the word table, at most
LONG_ENTRY = 256           # bytes; longer words are not kept by their owner

# a blank that no word follows: there, cutting before blanks is not safe
LOOSE = re.compile(r" (?:\s|$)")


def numbered(vocab, texts: list[str]):
    """(distinct words, numbers, offsets): text k is the words numbered
    numbers[offsets[k]:offsets[k + 1]], put together.  The ids of a text are the
    ids of its words; a text that only the library can encode is one word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    easy = [vocab.regular(t) and not LOOSE.search(t) for t in texts]
    cuts = [t.partition(" ") if e else ("", "", "") for t, e in zip(texts, easy)]
    rest = pc.split_pattern(pa.array([c[2] if c[1] else None for c in cuts], pa.large_string()), " ")
    coded = rest.flatten().dictionary_encode()
    words = [" " + w for w in coded.dictionary.to_pylist()]
    number = {}

    def own(word: str) -> int:
        return number.setdefault(word, len(words) + len(number))

    # before the blank-led words of a text come its first word, or all words of an irregular text
    first = []
    for t, e, c in zip(texts, easy, cuts):
        if e:
            first.append([own(c[0])] if c[0] else [])
        elif vocab.regular(t):
            first.append([own(w) for w in SPACED.findall(t)])
        else:
            first.append([own(t)])
    size = np.array([len(f) for f in first], dtype=np.int64)
    inner = np.diff(np.append(0, rest.value_lengths().fill_null(0).to_numpy().cumsum()))
    at = np.repeat(np.cumsum(inner) - inner, size)
    numbers = np.insert(coded.indices.to_numpy().astype(np.int64), at, [n for f in first for n in f])
    words.extend(number)
    return words, numbers, np.append(0, np.cumsum(inner + size))


def _owners(words: list[str], owners: int) -> list[list[int]]:
    """The numbers of the words of each owner, in word order."""
    from xxhash import xxh64_intdigest
    parts: list[list[int]] = [[] for _ in range(owners)]
    for k in sorted(range(len(words)), key=words.__getitem__):
        parts[xxh64_intdigest(words[k].encode()) % owners].append(k)
    return parts


def _squeezed(raw: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _back(blob: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob)


def _strings(parts: list[bytes]) -> bytes:
    return _squeezed(struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts))


def _split(blob: bytes) -> list[bytes]:
    raw = _back(blob)
    n = struct.unpack_from("<I", raw)[0]
    out, at = [], 4 + 4 * n
    for s in struct.unpack_from(f"<{n}I", raw, 4):
        out.append(raw[at:at + s])
        at += s
    return out


def _planes(numbers) -> bytes:
    """uint32 numbers, byte plane after byte plane: the high planes squeeze to nothing."""
    import numpy as np
    return _squeezed(np.ascontiguousarray(np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes):
    import numpy as np
    return np.ascontiguousarray(np.frombuffer(_back(blob), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def id_tables(vocab):
    """Arrow arrays by id: the decimal id with a comma, and the piece's bytes."""
    import pyarrow as pa
    table = {i: b for b, i in vocab.ranks.items()}
    table.update({i: s.encode() for s, i in vocab.special.items()})
    top = max(table) + 1
    return (pa.array([b"%d," % i for i in range(top)], pa.binary()),
            pa.array([table.get(i, b"") for i in range(top)], pa.binary()))


def _joined(pieces, numbers, bounds):
    """Arrow binary array whose k-th value puts together pieces[numbers[bounds[k]:bounds[k + 1]]]."""
    import numpy as np
    import pyarrow as pa
    flat = pieces.take(pa.array(numbers))
    edge = np.frombuffer(flat.buffers()[1], dtype=np.int32)[:len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = flat.buffers()[2] if len(flat) else None
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(edge[bounds].astype(np.int32))), data or pa.py_buffer(b"")])


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                  chunk_bytes: int = CHUNK_BYTES, with_values: bool = True) -> DataFrame:
    """Per document: id, n_tokens, and (``with_values``) ids array<int> and the
    decoded text, else their digests ids_sha256 and decoded_sha256 (ids in
    decimal joined by commas).  Byte-level vocabularies only."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = size_units(rows, "text", chunk_bytes)
    owners = min(OWNERS, chunks)
    rows = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"))

    def grouped(batches):
        """The rows of a batch by chunk, texts squeezed together."""
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            chunk = batch.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0)), len(order))
            texts = batch.column(1)
            for a, b in zip(edges, edges[1:]):
                at = pa.array(order[a:b])
                ids = batch.column(0).take(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(chunk[order[a]])], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids),
                     pa.array([_strings([t.as_py().encode() for t in texts.take(at)])], pa.binary())],
                    names=["chunk", "ids", "texts"])

    dealt = rows.mapInArrow(grouped, f"chunk bigint, ids array<{kind}>, texts binary")

    def texts_of(table) -> list[str]:
        return [t.decode() for blob in table.column("texts").to_pylist() for t in _split(blob)]

    def distinct_words(table):
        import pyarrow as pa
        words, _, _ = numbered(vocabulary(vocabulary_path), texts_of(table))
        parts = _owners(words, owners)
        own = [k for k, p in enumerate(parts) if p]
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array([chunk] * len(own), pa.int64()), pa.array(own, pa.int32()),
                         pa.array([_strings([words[n].encode() for n in parts[k]]) for k in own], pa.binary())],
                        names=["chunk", "owner", "words"])

    named = dealt.groupBy("chunk").applyInArrow(distinct_words, "chunk bigint, owner int, words binary")

    def encode(batches):
        import pyarrow as pa
        vocab = vocabulary(vocabulary_path)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                ids: list[int] = []
                sizes = []
                for w in _split(batch.column(2)[k].as_py()):
                    got = known.get(w)
                    if got is None:
                        text = w.decode()
                        got = vocab.word_ids(text) if vocab.regular(text) else vocab.library_ids(text)
                        if len(w) <= LONG_ENTRY:
                            if len(known) >= MAX_WORDS:
                                known.clear()
                            known[w] = got
                    ids += got
                    sizes.append(len(got))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1),
                     pa.array([_planes(sizes)], pa.binary()), pa.array([_planes(ids)], pa.binary())],
                    names=["chunk", "owner", "sizes", "ids"])

    entries = named.repartition(owners, "owner").mapInArrow(
        encode, "chunk bigint, owner int, sizes binary, ids binary")
    names = ["id", "n_tokens", "ids", "decoded"] if with_values else ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def assemble(left, right):
        import numpy as np
        import pyarrow as pa
        vocab = vocabulary(vocabulary_path)
        decimal, piece = worker_state(f"ids:{vocabulary_path}", lambda: id_tables(vocab))
        words, numbers, offsets = numbered(vocab, texts_of(left))
        parts = _owners(words, owners)
        # words in the order in which their owners answer
        place = np.zeros(len(words), dtype=np.int64)
        sizes, ids, done = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], 0
        for owner, s, i in zip(*(right.column(c).to_pylist() for c in ("owner", "sizes", "ids"))):
            place[parts[owner]] = done + np.arange(len(parts[owner]))
            done += len(parts[owner])
            sizes.append(_numbers(s))
            ids.append(_numbers(i))
        size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        bounds = np.append(0, np.cumsum(size))
        at = place[numbers]
        shown = _joined(_joined(decimal, flat, bounds), at, offsets)
        text = _joined(_joined(piece, flat, bounds), at, offsets)
        total = np.append(0, np.cumsum(size[at]))[offsets]
        ids_out, text_out = [], []
        for line, back in zip(shown, text):
            line, back = memoryview(line.as_buffer())[:-1], memoryview(back.as_buffer())
            if with_values:
                ids_out.append([int(x) for x in bytes(line).split(b",")] if len(line) else [])
                text_out.append(bytes(back).decode("utf-8", "replace"))
            else:
                ids_out.append(hashlib.sha256(line).hexdigest())
                text_out.append(hashlib.sha256(back).hexdigest())
        return pa.table([left.column("ids").combine_chunks().flatten(), pa.array(np.diff(total)),
                         pa.array(ids_out, pa.list_(pa.int32()) if with_values else pa.string()),
                         pa.array(text_out, pa.string())], names=names)

    third = "ids array<int>, decoded string" if with_values else "ids_sha256 string, decoded_sha256 string"
    out = dealt.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(
        assemble, f"id {kind}, n_tokens bigint, {third}")
    return out.withColumnRenamed("id", id_col)
