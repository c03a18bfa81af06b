"""Mixing sources to target weights by hash-threshold histograms.

Every source has a target number of words.  Sources in code point order (NULL
last) take the weights in turn and share all words of the corpus; a target
stops at ``max_copies`` times the words of its source and the excess goes to
the others by weight, until none is above.

A source whose target is q times its words and some more takes every document
q times and some documents once more: those whose hash lies below a threshold.
The threshold comes from histograms, not from a sort: words are summed by
source and hash bucket, the bucket where the running sum passes the budget is
found, and only the rows of that boundary bucket are summed again by the next
digit of the hash, until it holds one document, which is taken if that comes
nearer to the budget.  Thresholds are nested: a larger budget takes a superset.

Documents are dealt into tiers by their size against the target (above 1/16,
above 1/256, the rest), each tier with its share of the budget.  What one tier
takes too much or too little is handed to the next, so that a miss of half a
long document is made good by shorter ones.

The hash is the MD5 of id and text, so reruns and other partitionings take the
same documents; rows alike in id and text differ only by a row number, and
which of them is taken does not show in the result.  DataFrame functions only.

Defined results: NULL text has size 0; documents of size 0 and of sources
without words are taken 0 times; NULL is a source of its own; repeated rows are
separate documents; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import stored
from mixlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
TIERS = (16, 256)            # a document is in the first tier whose share of the target (1/16, 1/256) it exceeds
DIGIT = 12                   # bits of the hash that one histogram reads
KEY_BITS = 60                # bits of each of the three key columns: two of the hash, one of the row number
DIGITS = KEY_BITS // DIGIT
KEYS, CUTS = ("k1", "k2", "k3"), ("t1", "t2", "t3")
MAX_BROADCAST_SOURCES = 100_000      # rows of at most about 200 bytes; above it, salted shuffle joins
SALTS = 32


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, src, size, k1, k2, k3), stored: the words of each document and its place in hash order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.col(source_col).cast("string")
    md5 = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        md5.alias("_md5"),
    ).select("doc_id", "source", "src", "size",
             F.conv(F.substring("_md5", 1, 15), 16, 10).cast("bigint").alias("k1"),
             F.conv(F.substring("_md5", 16, 15), 16, 10).cast("bigint").alias("k2"),
             F.monotonically_increasing_id().alias("k3")))


def targets(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """One row per source: (src, source_size, target).  Sources are few against
    documents; the windows over all of them hold one short row each."""
    common = math.lcm(*weights)
    whole = F.array(*[F.lit(int(w)) for w in weights])
    per = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    # NULL has the empty key and comes last
    by_name = Window.orderBy(F.col("src") == "", "src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(whole, turn + 1).cast("bigint"))
    # sources reach their limit in the order of size over weight; the first that does not ends the resharing
    by_limit = Window.orderBy(F.col("source_size").cast("decimal(38,0)") * F.expr(f"{common} div w"), "src")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    per = per.select(
        "src", "source_size", "w",
        (F.sum("source_size").over(everything) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
        F.row_number().over(by_limit).alias("n"))
    wide = "decimal(38,0)"
    free = F.col("left").cast(wide) * F.col("w") < F.lit(max_copies).cast("decimal(10,0)") * F.col("source_size") * F.col("left_w").cast("decimal(18,0)")
    first = F.min(F.when(free, F.struct("n", "left", "left_w"))).over(everything)
    per = per.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("n") < F.col("first.n"))
    return per.select("src", "source_size", F.when(capped, (max_copies * F.col("source_size")).cast("double")).otherwise(
        F.col("first.left").cast("double") * F.col("w") / F.col("first.left_w")).alias("target"))


def with_source(rows: DataFrame, per: DataFrame, few: bool, on: list[str]) -> DataFrame:
    """Inner join with a table of a few rows per source, which has a hot one: a
    checked broadcast, or else the rows of each source dealt over salts."""
    if few:
        return rows.join(F.broadcast(per), on)
    spread = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("k1", "k3"), F.lit(SALTS)).cast("int")).join(
        spread, [*on, "_salt"]).drop("_salt")


def _digit(level: int):
    key, at = KEYS[level // DIGITS], level % DIGITS
    return F.shiftright(key, KEY_BITS - DIGIT * (at + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _crossed(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source: ``need`` (what is left of the budget when all whole buckets
    below it are taken), and the boundary bucket ``digit`` with its ``n`` rows,
    NULL if the budget takes every bucket.  A budget below 0 has the first bucket."""
    run = Window.partitionBy("src").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.withColumn("upto", F.sum("words").over(run)).join(budgets, "src")
    at = (F.col("upto") > F.col("budget"))
    found = sums.groupBy("src").agg(
        F.min(F.when(at, F.struct("digit", "n", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("need")))).alias("cut"),
        F.max(F.struct("upto", (F.col("budget") - F.col("upto")).alias("need"))).alias("all"))
    return budgets.join(found, "src", "left").select(
        "src", F.coalesce("cut.need", "all.need", "budget").alias("need"), F.col("cut.digit").alias("digit"),
        F.col("cut.n").alias("n"))


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """(src, t1, t2, t3, left): rows of the source whose key is at or below the
    three numbers are taken; ``left`` is the budget minus their words.  All rows
    are summed once, then the rows of boundary buckets only."""
    state = budgets.select("src", "budget", *[F.lit(0).cast("bigint").alias(t) for t in CUTS])
    done = None
    for level in range(DIGITS * len(KEYS)):
        histogram = rows.groupBy("src", _digit(level).cast("int").alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"))
        step = cut_lineage(_crossed(histogram, state.select("src", "budget")).join(state.drop("budget"), "src"))
        key, room = level // DIGITS, KEY_BITS - DIGIT * (level % DIGITS)      # room: bits of this key not fixed yet
        # no boundary bucket: the budget takes every row that begins with the digits so far
        settled = step.filter("digit IS NULL").select("src", *[
            (F.col(t) if i < key else F.col(t).bitwiseOR(F.lit((1 << (room if i == key else KEY_BITS)) - 1))).alias(t)
            for i, t in enumerate(CUTS)], F.col("need").alias("left"))
        done = settled if done is None else done.unionByName(settled)
        state = step.filter("digit IS NOT NULL").select("src", F.col("need").alias("budget"), "n", "digit", *[
            (F.col(t).bitwiseOR(F.shiftleft(F.col("digit").cast("bigint"), room - DIGIT)) if i == key else F.col(t)).alias(t)
            for i, t in enumerate(CUTS)])
        most = state.agg(F.max("n")).first()[0]
        if most is None:
            break
        rows = cut_lineage(with_source(rows, state.select("src", F.col("digit").alias("_digit")), few, ["src"])
                           .filter(_digit(level) == F.col("_digit")).drop("_digit"))
        if most == 1:
            # the boundary row itself: taken if that comes nearer to the budget
            taken = F.col("size") - F.col("budget") < F.col("budget")
            last = with_source(rows, state.select("src", "budget"), few, ["src"])
            done = done.unionByName(last.select(
                "src", F.col("k1").alias("t1"), F.col("k2").alias("t2"), (F.col("k3") - F.when(taken, 0).otherwise(1)).alias("t3"),
                F.when(taken, F.col("budget") - F.col("size")).otherwise(F.col("budget")).alias("left")))
            break
        state = state.select("src", "budget", *CUTS)
    return cut_lineage(done)


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source", max_broadcast: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, taken);
    ``taken`` is its words times the copies the mix takes."""
    rows = sized(docs, id_col, text_col, source_col)
    per = cut_lineage(targets(rows, weights, max_copies).withColumn(
        "copies", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("bigint"))
        .withColumn("share", F.coalesce(F.try_divide(F.col("target") - F.col("copies") * F.col("source_size"),
                                                     F.col("source_size").cast("double")), F.lit(0.0))))
    few = per.count() <= max_broadcast
    tier = F.lit(len(TIERS))
    for i, part in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("size") * part > F.col("target"), i).otherwise(tier)
    placed = stored(with_source(rows, per, few, ["src"]).withColumn("tier", tier.cast("int")))
    words = cut_lineage(placed.groupBy("src", "tier").agg(F.sum("size").alias("words")))
    owed = per.select("src", F.lit(0.0).alias("left"))
    cuts = None
    for i in range(len(TIERS) + 1):
        here = placed.filter((F.col("tier") == i) & (F.col("size") > 0)).select("src", "size", *KEYS)
        budget = per.join(words.filter(F.col("tier") == i), "src", "left").join(owed, "src").select(
            "src", (F.col("share") * F.coalesce("words", F.lit(0)) + F.col("left")).alias("budget"))
        found = thresholds(here, cut_lineage(budget), few)
        owed = found.select("src", "left")
        found = found.withColumn("tier", F.lit(i))
        cuts = found if cuts is None else cuts.unionByName(found)
    once_more = F.struct(*KEYS) <= F.struct(*[F.col(t).alias(k) for t, k in zip(CUTS, KEYS)])
    return with_source(placed, cut_lineage(cuts.drop("left")), few, ["src", "tier"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + F.when(once_more, 1).otherwise(0))).alias("taken"))
