"""Token-id output as Re-Pair grammars.

Documents are range-partitioned by id, so files in order hold ascending ids.
A shard is one binary record of at most about ``SHARD_CHARS`` characters of
text: frequent id pairs are replaced by nonterminals, round after round, and
the shard keeps the rules, every symbol's expansion length, the sequence, and
where each document starts in it.  Any id range is decoded by walking the
expansion lengths to the symbols that cover it.

A round replaces the pair occurrences that are more frequent than both
overlapping neighbours, so many nonterminals are made at once and no two
replacements overlap.  Rounds first run inside the distinct words of a shard,
weighted by how often each occurs, then across words on the shortened
sequence, each until no pair is left that occurs ``LEAST`` times.  Pairs never span a document's end.

Record layout (all little-endian): magic ``RPG1``; uint32 counts of documents,
rules, symbols; int64 document ids; uint8 null flags of the ids; uint32 first
symbol of each document (and the end); uint32 left and right symbol of each
rule; uint32 expansion length of each rule; uint32 symbols.  Symbols below
``2**20`` are token ids, rule r is symbol ``2**20 + r``.

Defined results: NULL text counts as empty (only the end id); NULL ids sort
first; rows that repeat an id follow each other in text order; other columns
are ignored; an empty table writes no record.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.bpe import vocabulary
from mixlens.llm.common import gather, size_units, stored

MAGIC = b"RPG1"
RULE0 = 1 << 20            # first nonterminal
SHARD_CHARS = 4_000_000   # characters of text in one record, about
RANGE_BYTES = 32 << 20     # text bytes of one range partition
LEAST = 4                  # a rule pays from this many occurrences on


def _frequent(seq, closed, weight, least: int):
    """The open places of ``seq`` whose pair may occur ``least`` times, by a hashed
    count: most pairs are rare and need no sorting."""
    import numpy as np
    key = (seq[:-1] << 32) | seq[1:]
    open_ = ~closed[:-1]
    bits = min(22, len(seq).bit_length())
    slot = ((key * np.int64(-7046029254386353131)) >> np.int64(64 - bits)) & np.int64((1 << bits) - 1)
    rough = np.bincount(slot[open_], weights=None if weight is None else weight[:-1][open_], minlength=1 << bits)
    return np.flatnonzero(open_ & (rough[slot] >= least))


def _round(seq, closed, weight, at, first_symbol: int, least: int = LEAST):
    """One round of pair replacement.  ``closed`` marks positions after which no
    pair may start (ends of words or documents), ``weight`` counts an occurrence,
    ``at`` lists in order the open places that hold every pair occurring ``least`` times.
    Returns (seq, closed, weight, at, pairs) with the new rules as (left, right) rows."""
    import numpy as np
    same = seq, closed, weight, at, np.zeros((0, 2), np.int64)
    if not len(at):
        return same
    key = (seq[at] << 32) | seq[at + 1]
    # in a run of one id (equal overlapping pairs) every other occurrence counts, so the
    # most frequent pair is replaced at all its places: a round without a rule is the last
    again = np.append(False, (np.diff(at) == 1) & (key[1:] == key[:-1]))
    spot = np.arange(len(at))
    counted = (spot - np.maximum.accumulate(np.where(again, 0, spot))) % 2 == 0
    found, inverse = np.unique(key[counted], return_inverse=True)
    often = np.bincount(inverse, weights=None if weight is None else weight[at[counted]])
    # only places with a pair worth replacing are compared with their neighbours; no other pair
    # of these symbols gets more frequent later, so the next round does not look at it
    inverse = inverse[np.cumsum(counted) - 1]
    worth = often[inverse] >= least
    at, inverse, counted = at[worth], inverse[worth], counted[worth]
    place, m = at[counted], inverse[counted]
    if not len(place):
        return same
    c = often[m]
    beside = np.diff(place) == 1
    more = (c[1:] > c[:-1]) | ((c[1:] == c[:-1]) & (m[1:] > m[:-1]))
    less = (c[1:] < c[:-1]) | ((c[1:] == c[:-1]) & (m[1:] < m[:-1]))
    best = np.append(True, ~beside | more) & np.append(~beside | less, True)
    pick, chosen = place[best], m[best]
    used = np.bincount(chosen, weights=None if weight is None else weight[pick], minlength=len(found))
    good = np.flatnonzero(used >= least)
    if not len(good):
        return same
    rule_of = np.full(len(found), -1, dtype=np.int64)
    rule_of[good] = first_symbol + np.arange(len(good))
    keep_pick = rule_of[chosen] >= 0
    pick, chosen = pick[keep_pick], chosen[keep_pick]
    seq[pick] = rule_of[chosen]
    closed[pick] = closed[pick + 1]
    stay = np.ones(len(seq), dtype=bool)
    stay[pick + 1] = False
    # what the next round looks at: these places as far as they last, and those beside a new symbol
    look = np.zeros(len(seq), dtype=bool)
    look[at] = True
    look[pick] = True
    look[pick[pick > 0] - 1] = True
    seq, closed = seq[stay], closed[stay]
    at = np.flatnonzero(look[stay] & ~closed)
    pairs = np.stack([found[good] >> 32, found[good] & np.int64(0xFFFFFFFF)], axis=1)
    return seq, closed, None if weight is None else weight[stay], at, pairs


def _rounds(seq, closed, weight, first_symbol: int):
    """Rounds until no pair occurs ``LEAST`` times: (seq, closed, list of the rounds' pairs)."""
    at, rules = _frequent(seq, closed, weight, LEAST), []
    while True:
        seq, closed, weight, at, pairs = _round(seq, closed, weight, at, first_symbol)
        if not len(pairs):
            return seq, closed, rules
        rules.append(pairs)
        first_symbol += len(pairs)


def grammar(pool, offsets, lengths, stream, ends):
    """Re-Pair of a text given as a stream of words.  Word w has the ids
    pool[offsets[w] : +lengths[w]]; ``ends`` marks the last word of a document.
    Returns (rules, sequence, position in the sequence after each document)."""
    import numpy as np
    # inside the distinct words, weighted by their occurrences
    times = np.bincount(stream, minlength=len(lengths)).astype(np.float64)
    seq = gather(pool, offsets, lengths).astype(np.int64)
    closed = np.zeros(len(seq), dtype=bool)
    closed[np.cumsum(lengths)[lengths > 0] - 1] = True
    seq, closed, rules = _rounds(seq, closed, np.repeat(times, lengths), RULE0)
    size = np.zeros(len(lengths), dtype=np.int64)
    last = np.flatnonzero(closed)
    full = np.flatnonzero(lengths > 0)
    size[full] = np.diff(np.append(-1, last))
    start = np.cumsum(size) - size
    # across words
    per_word = size[stream]
    text = gather(seq, start[stream], per_word)
    done = np.cumsum(per_word)[ends]
    shut = np.zeros(len(text), dtype=bool)
    shut[done - 1] = True
    text, shut, more = _rounds(text, shut, None, RULE0 + sum(map(len, rules)))
    rules += more
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return table, text, np.flatnonzero(shut) + 1


def expansion_lengths(rules):
    """Ids that each rule stands for; a rule only names ids and earlier rules."""
    import numpy as np
    size = np.ones(len(rules), dtype=np.int64)
    pending = np.arange(len(rules))
    known = np.zeros(len(rules) + 1, dtype=bool)
    known[-1] = True
    while len(pending):
        a, b = rules[pending, 0] - RULE0, rules[pending, 1] - RULE0
        ready = (known[np.maximum(a, -1)]) & (known[np.maximum(b, -1)])
        now = pending[ready]
        a, b = a[ready], b[ready]
        size[now] = np.where(a >= 0, size[np.maximum(a, 0)], 1) + np.where(b >= 0, size[np.maximum(b, 0)], 1)
        known[now] = True
        pending = pending[~ready]
    return size


def write_record(doc_ids, rules, sequence, doc_ends) -> bytes:
    import numpy as np
    sizes = expansion_lengths(rules)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    starts = np.append(0, doc_ends).astype("<u4")
    return b"".join([MAGIC, struct.pack("<III", len(ids), len(rules), len(sequence)), ids.tobytes(), nulls.tobytes(),
                     starts.tobytes(), rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(),
                     sizes.astype("<u4").tobytes(), sequence.astype("<u4").tobytes()])


class Record:
    """A record read back; ``document(k)`` and ``ids(a, b)`` decode without the rest."""

    def __init__(self, raw: bytes):
        import numpy as np
        if raw[:4] != MAGIC:
            raise ValueError("not a token record")
        n, r, s = struct.unpack_from("<III", raw, 4)
        at = 16

        def take(kind, count):
            nonlocal at
            part = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += part.nbytes
            return part

        ids, nulls = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.starts = take("<u4", n + 1).astype(np.int64)
        self.rules = np.stack([take("<u4", r), take("<u4", r)], axis=1).astype(np.int64)
        self.sizes = take("<u4", r).astype(np.int64)
        self.sequence = take("<u4", s).astype(np.int64)
        self._pool = None

    def lengths(self, symbols):
        import numpy as np
        size = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= RULE0
        size[rule] = self.sizes[symbols[rule] - RULE0]
        return size

    def _expansions(self):
        """(pool, offsets): the ids of every rule, built level by level."""
        import numpy as np
        if self._pool is None:
            offset = np.cumsum(self.sizes) - self.sizes
            pool = np.zeros(int(self.sizes.sum()), dtype=np.uint32)
            ready = np.zeros(len(self.rules) + 1, dtype=bool)
            ready[-1] = True
            pending = np.arange(len(self.rules))
            while len(pending):
                a, b = self.rules[pending, 0], self.rules[pending, 1]
                ok = ready[np.maximum(a - RULE0, -1)] & ready[np.maximum(b - RULE0, -1)]
                now = pending[ok]
                shift = np.zeros(len(now), dtype=np.int64)
                for side in (a[ok], b[ok]):
                    size = self.lengths(side)
                    one = side < RULE0
                    pool[offset[now[one]] + shift[one]] = side[one]
                    many = ~one
                    if many.any():
                        ids = gather(pool, offset[side[many] - RULE0], size[many])
                        to = np.repeat(offset[now[many]] + shift[many] - (np.cumsum(size[many]) - size[many]), size[many])
                        pool[to + np.arange(len(ids))] = ids
                    shift += size
                ready[now] = True
                pending = pending[~ok]
            self._pool = pool, offset
        return self._pool

    def expand(self, symbols):
        import numpy as np
        pool, offset = self._expansions()
        terminals = np.flatnonzero(symbols < RULE0)
        both = np.concatenate([pool, symbols[terminals].astype(np.uint32)])
        at = np.empty(len(symbols), dtype=np.int64)
        at[terminals] = len(pool) + np.arange(len(terminals))
        rule = np.flatnonzero(symbols >= RULE0)
        at[rule] = offset[symbols[rule] - RULE0]
        return gather(both, at, self.lengths(symbols))

    def document(self, k: int):
        return self.expand(self.sequence[self.starts[k]:self.starts[k + 1]])

    def ids(self, a: int, b: int):
        """Ids a..b of the record, decoding only the symbols that cover them."""
        import numpy as np
        edge = np.append(0, np.cumsum(self.lengths(self.sequence)))
        i = int(np.searchsorted(edge, a, side="right")) - 1
        j = int(np.searchsorted(edge, b, side="left"))
        return self.expand(self.sequence[i:j])[a - edge[i]:b - edge[i]]


class _Shard:
    """Collects documents until the record is full."""

    def __init__(self, vocab, end_id):
        self.vocab, self.end_id = vocab, end_id
        self.doc_ids: list = []
        self.texts: list[str] = []
        self.chars = 0

    def add(self, doc_id, text: str):
        self.doc_ids.append(doc_id)
        self.texts.append(text)
        self.chars += len(text) + 1

    def record(self) -> bytes:
        import numpy as np
        vocab = self.vocab
        odd = [k for k, t in enumerate(self.texts) if not vocab.regular(t)]
        # an odd text is one word of its own, encoded by the library
        own = [np.array(vocab.library_ids(self.texts[k]), dtype=np.uint32).tobytes() for k in odd]
        for k in odd:
            self.texts[k] = ""
        words, stream, offsets = vocab.word_table(self.texts)
        known, cached = vocab.cache.get, vocab.cached
        parts = [known(w) or cached(w) for w in words] + own + [np.array([self.end_id], dtype=np.uint32).tobytes()]
        at = np.append(offsets[1:][odd], offsets[1:])
        new = np.append(len(words) + np.arange(len(odd)), np.full(len(self.texts), len(parts) - 1))
        stream = np.insert(stream, at, new.astype(np.int32))
        ends = offsets[1:] + np.arange(len(self.texts)) + np.searchsorted(odd, np.arange(len(self.texts)), side="right")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), dtype=np.uint32)
        rules, sequence, doc_ends = grammar(pool, np.cumsum(lengths) - lengths, lengths, stream, ends)
        return write_record(self.doc_ids, rules, sequence, doc_ends)


def records(docs: DataFrame, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id",
            text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(part, shard, n_docs, n_ids, record): the shards of ``docs`` in ascending id order."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = size_units(rows, "text", RANGE_BYTES)
    dealt = (rows.repartitionByRange(parts, F.col("id").asc_nulls_first())
             .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
             .select("id", "text", F.spark_partition_id().alias("part")))

    def run(batches):
        import pyarrow as pa
        vocab = vocabulary(vocabulary_path)
        shard, number, part = _Shard(vocab, end_id), 0, 0

        def full():
            raw = shard.record()
            rec = Record(raw)
            n_ids = int(rec.lengths(rec.sequence).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(shard.doc_ids)], pa.int64()),
                 pa.array([n_ids], pa.int64()), pa.array([raw], pa.binary())],
                names=["part", "shard", "n_docs", "n_ids", "record"])

        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column(2)[row].as_py()
                shard.add(batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if shard.chars >= shard_chars:
                    yield full()
                    shard, number = _Shard(vocab, end_id), number + 1
        if shard.doc_ids:
            yield full()

    return dealt.mapInArrow(run, "part int, shard int, n_docs bigint, n_ids bigint, record binary")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the records alone: id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: a few bytes for each 4 MB of text
    base = files.select("part", "shard", "n_ids").select(
        "part", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                rec = Record(batch.column(2)[row].as_py())
                ids = rec.expand(rec.sequence).astype("<u4")
                edge = np.append(0, np.cumsum(rec.lengths(rec.sequence)))[rec.starts]
                view = memoryview(ids.tobytes())
                n = len(rec.doc_ids)
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * n, pa.int32()),
                     pa.array([batch.column(1)[row].as_py()] * n, pa.int32()), pa.array(rec.doc_ids, pa.int64()),
                     pa.array(edge[:-1], pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = files.select("part", "shard", "record").mapInArrow(
        run, "part int, shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, vocabulary_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes the records (Parquet files of one binary record per row) to ``path``,
    or to the shared checkpoint folder, and returns them as read back."""
    out = records(docs, vocabulary_path, **options)
    if path is None:
        return stored(out)
    out.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.parquet(path)
