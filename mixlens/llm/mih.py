"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are 64 bits, cut into four 16-bit segments.  Distinct codes are dealt
over shards of bounded size; a shard indexes each segment by its value.  A
query probes all values within radius 0, then 1, 2, ... of its own segments,
verifies the full distance of what it meets, and stops when the k-th verified
distance is provably covered: after radius r in every segment, each code
within 4 (r + 1) - 1 bits has been met.  The best k of all shards are merged
per query.  Nothing is sampled and recall is 1.

Codes of embeddings: bit d is 1 if component d is >= 0 (64 dimensions).
Other widths: 64 sign bits of sums over the components d, d+64, ...

Defined results: rows whose vector is NULL, empty or holds a NULL or NaN have
no code: they are neither queries nor answers; a NULL id is neither; rows that
repeat an id are separate answers, but never answers to that id; ties go to
the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import stored

SEGMENTS, WIDTH = 4, 16
SHARD = 1 << 16          # distinct codes of one shard, about
QUERIES = 512            # queries of one block


def sign_code(vec: Column, bits: int = 64) -> Column:
    """The signed 64-bit code of an array column; NULL where undefined."""
    usable = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    wide = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.aggregate(
        F.filter(vec, lambda x, i: i % bits == b), F.lit(0.0), lambda s, x: s + x))
    sums = F.when(F.size(vec) == bits, vec.cast("array<double>")).otherwise(wide)
    code = F.aggregate(F.transform(sums, lambda x, i: F.when(
        x >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    return F.when(F.coalesce(usable, F.lit(False)), code)


def _masks():
    """For each radius 0..16, the 16-bit numbers with that many ones."""
    import numpy as np
    every = np.arange(1 << WIDTH, dtype=np.uint32)
    ones = np.bitwise_count(every)
    return [every[ones == r] for r in range(WIDTH + 1)]


class ShardIndex:
    """The segment tables of one shard's distinct codes."""

    def __init__(self, codes):
        import numpy as np
        self.codes = codes
        self.tables = []
        for s in range(SEGMENTS):
            value = ((codes >> np.uint64(WIDTH * s)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << WIDTH) + 1))
            self.tables.append((order, first))

    def search(self, code, enough, masks):
        """(positions, distances) of codes around ``code``: radii grow until
        ``enough(distances)`` answers lie within the distance covered."""
        import numpy as np
        met = np.zeros(len(self.codes), dtype=bool)
        positions, distances = [], []
        code = np.uint64(code)
        for radius in range(WIDTH + 1):
            for s, (order, first) in enumerate(self.tables):
                own = int(code >> np.uint64(WIDTH * s)) & 0xFFFF
                probe = masks[radius] ^ own
                a, b = first[probe], first[probe + 1]
                full = b > a
                if not full.any():
                    continue
                a, n = a[full], (b - a)[full]
                start = np.cumsum(n) - n
                at = order[np.repeat(a - start, n) + np.arange(int(n.sum()))]
                at = at[~met[at]]
                if len(at):
                    met[at] = True
                    positions.append(at)
                    distances.append(np.bitwise_count(self.codes[at] ^ code).astype(np.int64))
            if positions and enough(distances, SEGMENTS * (radius + 1) - 1, positions):
                break
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(positions), np.concatenate(distances)


def _blobs(codes: DataFrame, block: Column, members: str) -> DataFrame:
    """Rows (code, members array<bigint>) folded to one binary row per block."""
    def fold(key, table):
        import numpy as np
        import pyarrow as pa
        ids = table.column(members).combine_chunks()
        return pa.table([
            pa.array([key[0].as_py()], pa.int64()),
            pa.array([table.column("code").to_numpy().astype("<i8").tobytes()], pa.binary()),
            pa.array([np.diff(ids.offsets.to_numpy()).astype("<i8").tobytes()], pa.binary()),
            pa.array([ids.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
        ], names=["block", "codes", "sizes", "ids"])
    return codes.withColumn("_block", block).groupBy("_block").applyInArrow(
        fold, "block bigint, codes binary, sizes binary, ids binary")


def top_k(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", code_col: str = "code",
          shard: int = SHARD, query_block: int = QUERIES) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k nearest other rows of every
    row that satisfies ``queries``; fewer if there are fewer."""
    coded = stored(rows.filter(queries.isNotNull() & F.col(id_col).isNotNull() & F.col(code_col).isNotNull())
                   .select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).alias("code"),
                           queries.alias("asks")))
    # of one code only its k + 1 smallest ids can be answers (one of them may be the query), each k times at most
    first = Window.partitionBy("code").orderBy("id")
    kept = (coded.groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
            .withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1))
    codes = stored(kept.groupBy("code").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_repeat("id", F.col("m"))))).alias("ids")))
    n = codes.count()
    shards = max(1, -(-n // shard))
    asked = coded.filter("asks").select("id", "code").distinct()
    blocks = max(1, -(-asked.count() // query_block))
    index = _blobs(codes, F.pmod(F.xxhash64("code"), F.lit(shards)), "ids")
    wanted = _blobs(asked.select("code", F.array("id").alias("ids")), F.pmod(F.xxhash64("ids"), F.lit(blocks)), "ids")
    wanted = wanted.select(F.col("block").alias("qblock"), F.col("codes").alias("qcodes"), F.col("ids").alias("qids"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("block"))
    met = wanted.join(index, "block").repartition(F.col("qblock"), F.col("block"))

    def search(batches):
        import numpy as np
        import pyarrow as pa
        masks = _masks()
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row].as_py() for name in ("qcodes", "qids", "codes", "sizes", "ids")}
                qcodes, qids = np.frombuffer(cell["qcodes"], "<u8"), np.frombuffer(cell["qids"], "<i8")
                sizes, ids = np.frombuffer(cell["sizes"], "<i8"), np.frombuffer(cell["ids"], "<i8")
                first = np.cumsum(sizes) - sizes
                shard_index = ShardIndex(np.frombuffer(cell["codes"], "<u8"))
                by_id = np.argsort(ids, kind="stable")
                owner, in_order = np.repeat(np.arange(len(sizes)), sizes)[by_id], ids[by_id]

                out = ([], [], [])
                for code, me in zip(qcodes, qids):
                    a, b = np.searchsorted(in_order, me, "left"), np.searchsorted(in_order, me, "right")
                    own = np.bitwise_count(shard_index.codes[owner[a:b]] ^ code)

                    def enough(distances, covered, positions):
                        # k answers besides the query's own rows lie within the covered distance
                        met = sum(int(sizes[p[d <= covered]].sum()) for p, d in zip(positions, distances))
                        return met - int((own <= covered).sum()) >= k

                    at, dist = shard_index.search(code, enough, masks)
                    who = ids[np.repeat(first[at] - (np.cumsum(sizes[at]) - sizes[at]), sizes[at])
                              + np.arange(int(sizes[at].sum()))] if len(at) else ids[:0]
                    far = np.repeat(dist, sizes[at]) if len(at) else dist
                    other = who != me
                    who, far = who[other], far[other]
                    best = np.lexsort((who, far))[:k]
                    out[0].append(np.full(len(best), me))
                    out[1].append(who[best])
                    out[2].append(far[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0]).astype(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int64)),
                     pa.array(np.concatenate(out[2]).astype(np.int32))], names=["query_id", "neighbour_id", "distance"])

    near = met.mapInArrow(search, "query_id bigint, neighbour_id bigint, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
