"""Ordered-series operators W1, W3-W8 for one series larger than a task.

``series.py`` works inside one window partition per key.  Here a single series
of any length is cut into blocks of exactly ``chunk`` rows, and every operator
is a scan on two levels: windows inside blocks, and a scan over one short row
per block that tells each block what came before it.  The block rows form a
series of their own, so a second level too long for a task is cut again.

  lay_out      range partitions in order, rows numbered by position plus the
               rows of the partitions before; no window over the whole series
  adstock      a block maps the state before it to ``rate**chunk * state + b``;
               the states are the adstock of the b's at rate ``rate**chunk``
  means, lag   rows near a block's edge are copied to the block beside it (halo)
  interpolate  last observed value before and first one after each block
  zscore       mean and SD are one aggregate, attached to every row

A laid-out frame has ``rn`` (1, 2, ...) and ``blk``; all operators keep both, so
chains share the exchange by ``blk``.  Results equal those of ``series.py``.
Rows alike in all order columns follow in any, but fixed, order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.operators import series as S
from mixlens.operators.joins import bounded_broadcast
from mixlens.session import cut_lineage

CHUNK = 1 << 14
RN, BLK = "rn", "blk"
_POSITION = (1 << 33) - 1        # low bits of monotonically_increasing_id: the row's place in its partition
_T = "__ls_"


def _add(a, b):
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _before(blocks: DataFrame, value: str, fn, combine, n: int, chunk: int) -> DataFrame:
    """(blk, before): ``fn`` over the values of all earlier blocks, by levels of
    ``chunk`` rows.  ``blocks`` has one row per block 0 .. n - 1 (or fewer)."""
    group = F.expr(f"{BLK} div {chunk}").alias("grp")
    rows = blocks.select(BLK, F.col(value).alias("v"), group)
    prior = Window.partitionBy("grp").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select(BLK, "grp", fn("v").over(prior).alias("before"))
    groups = -(-n // chunk)
    if groups <= 1:
        return near.select(BLK, "before")
    far = _before(rows.groupBy(F.col("grp").alias(BLK)).agg(fn("v").alias("v")), "v", fn, combine, groups, chunk)
    return near.join(far.select(F.col(BLK).alias("grp"), F.col("before").alias("far")), "grp", "left").select(
        BLK, combine(F.col("before"), F.col("far")).alias("before"))


def lay_out(df: DataFrame, order: str | Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with its row number and block, written once: range partitions hold
    about equal shares of the rows in order, each row knows its place in its
    partition, and a partition's offset is the sum of the counts before it."""
    order = [order] if isinstance(order, str) else list(order)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        f"{_T}id", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    part = F.shiftright(f"{_T}id", 33)
    counts = cut_lineage(placed.groupBy(part.alias(BLK)).agg(F.count("*").alias("n")))
    last, n = counts.agg(F.coalesce(F.max(BLK), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    offsets = bounded_broadcast(_before(counts, "n", F.sum, _add, int(last) + 1, chunk)
                                .select(F.col(BLK).alias(f"{_T}part"), F.coalesce("before", F.lit(0)).alias(f"{_T}off")))
    rn = F.col(f"{_T}off") + F.col(f"{_T}id").bitwiseAND(F.lit(_POSITION)) + 1
    out = placed.withColumn(f"{_T}part", part).join(offsets, f"{_T}part")
    out = out.select(*df.columns, rn.alias(RN, metadata={"rows": int(n)}))
    return out.withColumn(BLK, F.expr(f"({RN} - 1) div {chunk}"))


def rows_in(laid: DataFrame) -> int:
    """Rows of the series, noted on ``rn`` when it was laid out."""
    return laid.schema[RN].metadata["rows"]


def _inside() -> Window:
    return Window.partitionBy(BLK).orderBy(RN)


def adstock(laid: DataFrame, col: str, rate: float, out: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W1 over the whole series; a missing input counts as 0."""
    out = out or f"{col}_adstock"
    blocks = -(-rows_in(laid) // chunk)
    here = S.adstock(laid, col, rate, by=BLK, order=RN, out=out)
    if blocks <= 1 or rate == 0.0:
        return here
    place = (F.col(RN) - 1) % chunk
    x = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    # what a full block leaves behind of its own rows; the last block leaves nothing to anyone
    left = laid.groupBy(BLK).agg(F.sum(x * F.pow(F.lit(rate), F.lit(chunk - 1) - place)).alias("v"))
    left = left.select((F.col(BLK) + 1).alias(RN, metadata={"rows": blocks}), "v").withColumn(
        BLK, F.expr(f"({RN} - 1) div {chunk}"))
    state = adstock(cut_lineage(left), "v", rate ** chunk, out="state", chunk=chunk)
    state = bounded_broadcast(state.select(F.col(RN).alias(BLK), F.col("state").alias(f"{_T}state")))
    whole = F.col(out) + F.pow(F.lit(rate), place + 1) * F.coalesce(F.col(f"{_T}state"), F.lit(0.0))
    return here.join(state, BLK, "left").withColumn(out, whole).drop(f"{_T}state")


def with_halo(laid: DataFrame, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows, and copies (``own`` false) of each block's last ``before`` rows in the
    next block and of its first ``after`` rows in the block ahead of it."""
    if max(before, after) > chunk:
        raise ValueError(f"a window of {max(before, after)} rows reaches past a block of {chunk}")
    place = (F.col(RN) - 1) % chunk
    homes = [F.col(BLK)]
    if before:
        homes.append(F.when(place >= chunk - before, F.col(BLK) + 1))
    if after:
        homes.append(F.when((place < after) & (F.col(BLK) > 0), F.col(BLK) - 1))
    spread = laid.withColumn(f"{_T}home", F.explode(F.array_compact(F.array(*homes))))
    return spread.withColumn("own", F.col(f"{_T}home") == F.col(BLK)).withColumn(BLK, F.col(f"{_T}home")).drop(f"{_T}home")


def _own(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("own")


def lag(laid: DataFrame, col: str, n: int = 1, out: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W5 the value n rows back; NULL for the first n rows."""
    return _own(with_halo(laid, before=n, chunk=chunk).withColumn(out or f"{col}_lag{n}", F.lag(F.col(col), n).over(_inside())))


def rolling_mean_right(laid: DataFrame, col: str, k: int, out: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W3 mean of the last k rows, NULLs skipped; the first k - 1 rows take the
    first full mean; NULL throughout if the series has fewer than k rows."""
    out = out or f"{col}_mean{k}"
    near = with_halo(laid, before=k - 1, chunk=chunk)
    near = near.withColumn(out, F.avg(F.col(col)).over(_inside().rowsBetween(-(k - 1), 0)))
    if k > chunk:
        raise ValueError(f"a mean of {k} rows does not fit a block of {chunk}")
    # row k stands in the first block, as do all rows before it
    first = F.max(F.when(F.col(RN) == k, F.col(out))).over(Window.partitionBy(BLK))
    return _own(near.withColumn(out, F.when(F.col(RN) >= k, F.col(out)).when(F.col(BLK) == 0, first)))


def rolling_mean_center(laid: DataFrame, col: str, k: int, out: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W4 centred mean of k rows; both edges repeat the nearest full mean."""
    out = out or f"{col}_smooth"
    before, after = (k - 1) // 2, k // 2
    n = rows_in(laid)
    if n < k:
        return laid.withColumn(out, F.lit(None).cast("double"))
    near = with_halo(laid, before, after, chunk)
    near = _own(near.withColumn(out, F.avg(F.col(col)).over(_inside().rowsBetween(-before, after))))
    # the first and the last full mean, from the rows at both ends alone
    ends = laid.filter(F.col(BLK).isin(0, (k - 1) // chunk, (n - k) // chunk, (n - 1) // chunk))
    edges = ends.agg(F.avg(F.when(F.col(RN) <= k, F.col(col))).alias(f"{_T}l"),
                     F.avg(F.when(F.col(RN) > n - k, F.col(col))).alias(f"{_T}r"))
    return near.crossJoin(F.broadcast(edges)).withColumn(                # one row
        out, F.when(F.col(RN) <= before, F.col(f"{_T}l")).when(F.col(RN) > n - after, F.col(f"{_T}r")).otherwise(F.col(out))
    ).drop(f"{_T}l", f"{_T}r")


def interpolate(laid: DataFrame, col: str, out: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W8 missing values on the line between their neighbours by row position; the
    ends take the nearest observed value."""
    out = out or col
    x = F.col(col).cast("double")
    seen = F.when(x.isNotNull(), F.struct(F.col(RN).alias("r"), x.alias("x")))
    blocks = -(-rows_in(laid) // chunk)
    ends = cut_lineage(laid.groupBy(BLK).agg(F.max(seen).alias("v"), F.min(seen).alias("w")))
    past = _before(ends, "v", F.max, F.greatest, blocks, chunk).select(BLK, F.col("before").alias(f"{_T}p"))
    # the same from the far end: blocks counted backwards
    back = ends.select((F.lit(blocks - 1) - F.col(BLK)).alias(BLK), "w")
    ahead = _before(back, "w", F.min, F.least, blocks, chunk).select(
        (F.lit(blocks - 1) - F.col(BLK)).alias(BLK), F.col("before").alias(f"{_T}n"))
    carried = bounded_broadcast(past.join(ahead, BLK))
    rows = laid.join(carried, BLK)
    # both directions as running frames: a frame that shrinks from the front would cost the square of a block
    up = Window.partitionBy(BLK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(BLK).orderBy(F.desc(RN)).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.last(seen, ignorenulls=True).over(up), F.col(f"{_T}p"))
    after = F.coalesce(F.last(seen, ignorenulls=True).over(down), F.col(f"{_T}n"))
    rows = rows.withColumn(f"{_T}b", before).withColumn(f"{_T}a", after)
    b, a = F.col(f"{_T}b"), F.col(f"{_T}a")
    share = F.try_divide((F.col(RN) - b["r"]).cast("double"), (a["r"] - b["r"]).cast("double"))
    value = (F.when(x.isNotNull(), x).when(b.isNull(), a["x"]).when(a.isNull(), b["x"])
             .otherwise(b["x"] + (a["x"] - b["x"]) * share))
    return rows.withColumn(out, value).drop(f"{_T}p", f"{_T}n", f"{_T}b", f"{_T}a")


def zscore(laid: DataFrame, cols: str | Sequence[str], suffix: str = "_z") -> DataFrame:
    """W7 over the whole series: one aggregate for all columns, its row attached to
    every row.  A constant column gives 0, NULL stays NULL."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    x = {c: F.col(c).cast("double") for c in cols}
    stats = laid.agg(*[f(x[c]).alias(f"{_T}{m}_{c}") for c in cols for m, f in (("m", F.avg), ("s", F.stddev_samp))])
    rows = laid.crossJoin(F.broadcast(stats))                             # one row
    rows = rows.withColumns({c + suffix: F.when(x[c].isNotNull(), F.coalesce(
        F.try_divide(x[c] - F.col(f"{_T}m_{c}"), F.col(f"{_T}s_{c}")), F.lit(0.0))) for c in cols})
    return rows.drop(*[f"{_T}{m}_{c}" for c in cols for m in "ms"])
