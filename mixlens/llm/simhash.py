"""SimHash near-dedup by anchor points of a covering code.

Fingerprints (64 bits) that differ in at most 3 bits differ in at most one bit
in one of their two halves.  Each half is covered by the perfect Hamming code
on 31 of its bits (every 31-bit word is within one bit of exactly one code
word: covering radius 1) times the free 32nd bit.  The code words are the
anchors.  A fingerprint's home is the anchor nearest to its half, and it is
replicated to every anchor within covering radius + threshold = 2 bits (at
most 17 of 2^27 per half).  If two halves differ in at most one bit, the home
of one lies within two bits of the other, so every pair meets at an anchor and
is compared there in full.  Equal fingerprints are one class before that, so
copies never multiply.

Joins are sort-merge joins at every size: Spark counts an explode as no more
rows than it reads, and integers as small as their files, so it would
broadcast all replicas of a table whose file is just below its threshold.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``words`` words joined by blanks (fewer words: the whole sequence), XXH64 with
seed 42 of each shingle, a bit is 1 if set in over half of them.

Defined results: NULL and empty texts have fingerprint zero and link like any
other; a NULL doc_id is never a representative but takes its class's
component; repeated rows share it; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.llm.common import stored
from mixlens.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ROWS_AT_ONCE = 1 << 16     # shingle hashes turned into bits at a time


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-1]]
    last = min(words, len(found)) - 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip(starts, ends[last:])),
                         dtype=np.uint64, count=len(found) - last)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[k:k + ROWS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            signed = [f - (1 << 64) if f >> 63 else f for f in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=["id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col))


def _syndrome(half: Column) -> Column:
    """XOR of the positions 1..31 of the set bits among the low 31 bits."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, j)
    return out.cast("int")


def _flip(half: Column, position: Column) -> Column:
    return half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), position - 1))


def _anchors(fps: DataFrame) -> DataFrame:
    """(fp, half, home, near): the home anchor and all anchors within two bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.posexplode(F.array(low, high)).alias("half", "h"))
    rows = halves.withColumn("s", _syndrome(F.col("h"))).withColumn(
        "home", F.when(F.col("s") == 0, F.col("h")).otherwise(_flip(F.col("h"), F.greatest(F.col("s"), F.lit(1)))))
    free = F.lit(1 << 31)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)),
                 lambda i: (F.col("s") != 0) & (i < i.bitwiseXOR(F.col("s"))) & (i.bitwiseXOR(F.col("s")) != 0)),
        lambda i: _flip(_flip(F.col("h"), i), i.bitwiseXOR(F.col("s"))))
    return rows.withColumn("near", F.concat(F.array(F.col("home"), F.col("home").bitwiseXOR(free)), pairs))


def linked_fingerprints(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp, distinct) differing
    in at most ``max_bits`` (0 to 3) bits, a < b."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with a radius-1 code cover thresholds up to 3 bits")
    rows = _anchors(fps)
    homes = rows.select("half", F.col("home").alias("anchor"), F.col("fp").alias("x"))
    replicas = rows.select("half", F.explode("near").alias("anchor"), F.col("fp").alias("y"))
    # there are up to 34 replicas a fingerprint, which Spark does not count: never broadcast
    met = homes.join(replicas.hint("merge"), (homes["half"] == replicas["half"]) & (homes["anchor"] == replicas["anchor"])
                     & (F.col("x") != F.col("y"))
                     & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links."""
    rows = stored(fingerprints(docs, words, id_col, text_col))
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("rep")))
    links = linked_fingerprints(classes.select("fp"), max_bits)
    edges = (links.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")).hint("merge"), "a")
             .join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")).hint("merge"), "b")
             .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    groups = components(edges)
    known = (classes.join(groups.hint("merge"), classes["rep"] == groups["node"], "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return rows.join(known.hint("merge"), "fp").select(id_col, "fp", "component_id")
