"""Best-fit packing by minimum bin slack.

Documents become token ids plus an end id; only documents longer than the
capacity are cut, into pieces of exactly the capacity except that the first
piece takes the remainder.  Packing looks at the histogram of piece lengths
(at most ``capacity`` numbers, whatever the corpus size): for each bin the
largest length left is taken and a bitset subset-sum over the lengths still
available finds the fullest completion; that combination is removed as many
times as the counts allow.  Every piece then finds its bin from its length
and its rank among the pieces of that length; no piece passes the driver.

Defined results: NULL text counts as empty (one piece holding the end id, or
none if there is no end id);
a NULL doc_id is carried along; repeated rows are separate documents; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm.bpe import vocabulary
from mixlens.llm.common import stored

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
RANK_SLICE = 200_000       # pieces of one length ranked by one task at most, about


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int | None = 2,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece number, start (ids of the document before
    it), length, CRC-32 of its ids as little-endian uint32, and (``with_ids``)
    those bytes."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(id=id_type)
    if not with_ids:
        schema = schema.removesuffix(", ids binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        vocab = vocabulary(vocabulary_path)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            keys, number, start, length, crc, raw = [], [], [], [], [], []
            texts = batch.column(1)
            for row in range(batch.num_rows):
                ids = np.concatenate([vocab.ids(texts[row].as_py() or "").astype("<u4"), tail])
                n = len(ids)
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n, capacity), n] if n else []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b].tobytes()
                    keys.append(row)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            cols = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def fullest(room: int, left: dict[int, int]) -> list[int]:
    """The lengths (with repeats, none above its count in ``left``) whose sum is
    the largest not above ``room``; long lengths are preferred among equals.
    Subset sums are the bits of one integer; counts are split into powers of two."""
    layers = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for size in sorted((s for s, n in left.items() if n and s <= room)):
        n, step = min(left[size], room // size), 1
        while n:
            step = min(step, n)
            layers.append((size, step, reach))
            reach |= (reach << (size * step)) & mask
            n -= step
            step *= 2
    target = reach.bit_length() - 1
    chosen = []
    for size, step, before in reversed(layers):
        # take the longest lengths first: skip a layer only if the sum needs it not
        if target >= size * step and before >> (target - size * step) & 1:
            chosen += [size] * step
            target -= size * step
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies per bin, first bin, offset in bin):
    pieces of that length with those ranks fill those bins.  Each combination is
    repeated while the counts last, so the work follows the number of lengths,
    not the number of bins."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, next_bin = [], 0
    while left:
        top = max(left)
        left[top] -= 1
        combination = [top, *fullest(capacity - top, left)]
        left[top] += 1
        need: dict[int, int] = {}
        for size in combination:
            need[size] = need.get(size, 0) + 1
        times = min(left[s] // c for s, c in need.items())
        offset = 0
        for size in sorted(need, reverse=True):
            c = need[size]
            rows.append((size, used[size], used[size] + c * times, c, next_bin, offset))
            used[size] += c * times
            left[size] -= c * times
            offset += c * size
            if not left[size]:
                del left[size]
        next_bin += times
    return rows


def ranked(df: DataFrame, key: str, order: list[str], slice_rows: int = RANK_SLICE) -> DataFrame:
    """``rank`` (0, 1, ... without gaps) of each row among the rows of its key.
    A key's rows are dealt over slices by hash, numbered inside each slice, and
    shifted by the rows of the slices before: no key is one task's work."""
    from pyspark.sql import Window
    n = df.count()
    slices = max(1, -(-n // slice_rows))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    return (cut.withColumn("_row", F.row_number().over(inside) - 1)
            .join(shift, [key, "_slice"])
            .withColumn("rank", F.col("_row") + F.col("_shift")).drop("_row", "_shift", "_slice"))


def pack(parts: DataFrame, capacity: int = 1024, order: list[str] | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to piece rows with a ``length`` column.
    Every sequence is filled from offset 0 without gaps."""
    order = order or ["doc_id", "piece", "start", "ids_crc32"]
    counts = {int(r["length"]): int(r["n"]) for r in
              parts.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most ``capacity`` rows
    if any(s > capacity for s in counts):
        raise ValueError("a piece is longer than the capacity")
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, first, _, copies, base, offset in bin_plan(counts, capacity):
        plan.setdefault(size, []).append((first, copies, base, offset))

    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(kind)
    def place(length, rank):
        import numpy as np
        import pandas as pd
        sizes, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            first, copies, base, offset = (np.array(x, np.int64) for x in zip(*plan[int(size)]))
            k = np.searchsorted(first, ranks[at], side="right") - 1
            inside = ranks[at] - first[k]
            seq[at] = base[k] + inside // copies[k]
            off[at] = offset[k] + inside % copies[k] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    rows = ranked(parts, "length", order).withColumn("_place", place("length", "rank"))
    return rows.select(*parts.columns, F.col("_place.sequence_id").alias("sequence_id"),
                       F.col("_place.offset").alias("offset"))


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int | None = 2,
                     with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places.  The pieces are stored once, so the
    histogram and the ranks see the same rows."""
    return pack(stored(pieces(docs, vocabulary_path, capacity, end_id, with_ids=with_ids)), capacity)
