"""Fuzzy line dedup by MinHash.

1. Lines that repeat exactly become one row (first place, number of places).
2. A line's character shingles (``SHINGLE`` characters each) give ``BANDS`` times
   ``ROWS`` MinHash values; each band of them is one band key; one more value is
   the line's fine key.
3. Lines that share a band key are candidates.  Small buckets compare all pairs.
   In a larger bucket each line meets the bucket's centre (the line with most
   places) and the centre of the bucket's lines of its fine key.  Jaccard distance is a metric, so
   the distances to the centre, the sizes of the sets and the components so far
   exclude pairs.  Where up to ``GROUP`` lines of a bucket are left, the other pairs are
   all looked at.  Where more are left, those are that share a shingle
   of both lines' prefixes: with the shingles of a line ordered by the number of
   lines that hold them, two sets of similarity s meet in their first
   ``g - ceil(s * g) + 1``, and from the first common one on enough must follow.
   Every line of a bucket has a bitmap of ``WORDS`` * 64 bits, one of them set for each
   shingle: bits set in one of two lines only are shingles they do not share,
   and a pair with too many of them is not similar.
   No bucket is cut and no link inside one is lost.
4. Exact Jaccard similarity of the full shingle sets (as 64-bit hashes) decides
   each candidate.
5. Distributed union-find joins the links; of a component the line at its first
   place (by document, then position) stays, and every other place goes.

All of it is DataFrame operations; ``shingles``, ``signatures`` and ``band_keys`` say the
same in numpy, for measuring the recall of the bands.

Defined results: blank lines (white space of any kind) are never dropped; a NULL text stays NULL (0
lines); lines shorter than a shingle are compared as wholes; a NULL id sorts
first; rows that repeat id and text lose and keep the same lines, rows that
share only the id are separate documents; a document may end up without lines
(empty text); other columns pass through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import stored
from mixlens.llm.components import components

SHINGLE = 10               # characters
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
SMALL = 5                  # lines of a bucket that are compared pair by pair
GROUP = 32                 # lines with open pairs in a bucket that meet pair by pair, and not by prefixes
BLOCK = 2                  # shingles hashed in one row: more make a method that is compiled badly or, from 8, not at all
MARKED, WORDS = 4, 16      # shingles marked in one row; 64-bit words of a line's bitmap
SHIFTS = BANDS * ROWS // 4  # least and greatest of two hashes by this many shifts

_FINE = 0x5A17C3D2E4B69F01


def _blank(line: Column) -> Column:
    """Whether a line holds white space only, of any kind."""
    return ~line.rlike(r"(?U)[^\s\x1c-\x1f]")


def shingle_set(line: str, size: int = SHINGLE) -> Column:
    """The distinct shingle hashes of a column of texts: XXH64 of every window of ``size``
    characters (as UTF-32, whose windows are cut without a search); a text
    shorter than a window has one, of the text as a whole."""
    def windows(points):
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(points) - F.lit(4 * size), F.lit(0)) + 1, F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(points, i, F.lit(4 * size))))
    # as a lambda's variable the text is encoded once, not for every window
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "utf-32")), windows), F.lit(0)))


def _orders(one: list[str], two: list[str]) -> dict[str, Column]:
    """What the MinHash values are the least (even) or greatest (odd) of, over the shingle
    hashes of a row in the columns ``one``, and ``two`` with the hashes of those: least
    and greatest of both after shifts of 0, 8 ... 40 bits (an order decided by other
    bits each time), and that of the fine value."""
    found = [best(*[F.shiftleft(c, 8 * r) for c in side])
             for r in range(SHIFTS) for side in (one, two) for best in (F.least, F.greatest)]
    fine = F.least(*[F.col(c).bitwiseXOR(F.lit(_FINE)) for c in one])
    return {**{f"v{k}": v for k, v in enumerate(found)}, "fine": fine}


def _hashed(lines: DataFrame, size: int, block: int, names: list[str]) -> DataFrame:
    """The shingle hashes of ``lines`` (columns lid, line, others) in the columns ``x0``, ``x1`` ...,
    ``block`` in a row (the last of a line repeated), beside the columns ``names``."""
    step = 4 * size
    points = lines.select(*names, F.encode("line", "utf-32").alias("points"))
    blocks = points.withColumn("last", F.greatest(F.octet_length("points") - F.lit(step), F.lit(0))).select(
        *names, "points", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4 * block))).alias("i"))
    return blocks.select(*names, *[
        F.xxhash64(F.substring("points", F.least(F.col("i") + 4 * j, "last") + 1, F.lit(step))).alias(f"x{j}")
        for j in range(block)])


def signed(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(lid, n, keys, fine) of ``lines`` (columns lid, n, line): ``BANDS`` band keys and the
    fine key.  Every shingle becomes a value of a row of ``BLOCK`` shingles, so a
    line's least and greatest are plain aggregates, of which 32 bits are kept."""
    one, two = [f"x{j}" for j in range(BLOCK)], [f"y{j}" for j in range(BLOCK)]
    hashed = _hashed(lines.withColumn("n", F.col("n").cast("bigint")), size, BLOCK, ["lid", "n"])
    hashed = hashed.select("*", *[F.xxhash64(x).alias(y) for x, y in zip(one, two)])
    # each aggregate reads one column: one of many arguments costs more than all the hashing
    rows = hashed.select("lid", "n", *[v.alias(name) for name, v in _orders(one, two).items()])
    best = rows.groupBy("lid", "n").agg(
        *[F.shiftright((F.max if k % 2 else F.min)(f"v{k}"), 32).alias(f"v{k}") for k in range(BANDS * ROWS)],
        F.shiftright(F.min("fine"), 32).alias("fine"))
    keys = [F.xxhash64(F.lit(band), *[f"v{k}" for k in range(band, BANDS * ROWS, BANDS)]) for band in range(BANDS)]
    return best.select("lid", "n", F.array(*keys).alias("keys"), "fine")


def bitmaps(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(lid, windows, m0, m1 ...) of ``texts`` (columns lid, line): the number of windows, which is
    that of the shingles at least, and the line's bitmap."""
    one = [f"x{j}" for j in range(MARKED)]
    counted = texts.select("lid", "line", F.greatest(F.length("line") - F.lit(size - 1), F.lit(1)).cast("bigint").alias("windows"))
    rows = _hashed(counted, size, MARKED, ["lid", "windows"])
    rows = rows.select("lid", "windows", *[F.expr(f"shiftleft(1L, cast({x} & 63 as int))").alias(f"b{x}") for x in one],
                       *[F.expr(f"(shiftrightunsigned({x}, 6)) % {WORDS}").alias(f"w{x}") for x in one])
    words = [F.expr(" | ".join(f"if(w{x} = {k}, b{x}, 0L)" for x in one)).alias(f"m{k}") for k in range(WORDS)]
    return rows.select("lid", "windows", *words).groupBy("lid", "windows").agg(
        *[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(WORDS)])


def not_excluded(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the ``pairs`` whose ``bitmaps`` do not show that they are less similar."""
    def named(side):
        return marked.select(*[F.col(c).alias(f"{side}_{c}" if c != "lid" else side) for c in marked.columns])
    both = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b")
    apart = F.expr(" + ".join(f"bit_count(a_m{k} ^ b_m{k})" for k in range(WORDS)))
    # of x + y shingles at most, similar sets have x + y - 2 * common apart, and common is this share of x + y
    most = (F.col("a_windows") + F.col("b_windows")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
    return both.filter(apart <= most).select("a", "b")


def shingles(texts: list[str], size: int = SHINGLE):
    """(hashes, counts): what ``signed`` hashes, in numpy, to measure recall against: the
    hashes of all windows of every text, one text after the other, and how many each has."""
    import numpy as np
    from xxhash import xxh64_intdigest
    windows = [[t[i:i + size] for i in range(max(len(t) - size + 1, 1))] for t in texts]
    hashes = [xxh64_intdigest(w.encode("utf-32-be"), seed=42) for one in windows for w in one]
    return np.array(hashes, np.uint64), np.array([len(w) for w in windows], np.int64)


def signatures(texts: list[str], size: int = SHINGLE):
    """(keys, fine) in numpy: two texts share a key here where they do in ``signed``."""
    return band_keys(*shingles(texts, size))


def band_keys(hashes, counts):
    """``signatures`` from the hashes of all texts and how many each text has."""
    import numpy as np
    from xxhash import xxh64_intdigest
    starts = np.cumsum(counts) - counts
    again = np.array([xxh64_intdigest(h.tobytes(), seed=42) for h in hashes], np.uint64)
    values = [best.reduceat((x << np.uint64(8 * r)).view(np.int64), starts) >> 32
              for r in range(SHIFTS) for x in (hashes, again) for best in (np.minimum, np.maximum)]
    fine = np.minimum.reduceat((hashes ^ np.uint64(_FINE)).view(np.int64), starts) >> 32
    rows = np.stack(values, axis=1)
    keys = [[xxh64_intdigest(row[band::BANDS].tobytes(), seed=band) for band in range(BANDS)] for row in rows]
    return np.array(keys, np.uint64).view(np.int64), fine


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lid, line, at, n) of the distinct non-blank lines; ``at`` is the first place
    (id, text hash, position).  Stored, so lid is fixed."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    once = (lines.filter(~_blank(F.col("line"))).groupBy("line")
            .agg(F.min(F.struct("id", "th", "pos")).alias("at"), F.count("*").alias("n")))
    return stored(once.withColumn("lid", F.monotonically_increasing_id()))


def similarities(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, ga, gb, jaccard) of candidate pairs: sizes and exact similarity of the
    shingle sets.  They are dealt out one by one: a few bytes of ids are much work."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = texts.select("lid", "line")

    def named(side):
        return lines.select(F.col("lid").alias(side), F.col("line").alias(f"{side}_line"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "a_line", "b_line").repartition(parts)

    sets = both.select("a", "b", shingle_set("a_line", size).alias("x"), shingle_set("b_line", size).alias("y"))
    sizes = sets.select("a", "b", F.size("x").cast("bigint").alias("ga"), F.size("y").cast("bigint").alias("gb"),
                        F.size(F.array_intersect("x", "y")).alias("common"))
    return sizes.select("a", "b", "ga", "gb", (F.col("common") / (F.col("ga") + F.col("gb") - F.col("common"))).alias("jaccard"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def buckets(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(key, c, lid, centre, near) of the buckets of two lines and more: the number
    of lines, the bucket's centre and that of its lines with this fine key."""
    found = stored(signed(lines, size)).select("lid", "n", "fine", F.explode("keys").alias("key"))
    # counts alone first: most keys belong to one line
    several = found.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > 1)
    members = stored(found.join(several.hint("shuffle_hash"), "key"))
    middle = F.min(F.struct((-F.col("n")).alias("m"), "lid"))["lid"]
    whole = members.groupBy("key").agg(middle.alias("centre"))
    parts = members.groupBy("key", "fine").agg(middle.alias("near"))
    # rows of whole numbers are many times their file, by which Spark would broadcast them
    return stored(members.join(parts.hint("merge"), ["key", "fine"]).join(whole.hint("merge"), "key").select("key", "c", "lid", "centre", "near"))


def candidates(members: DataFrame) -> DataFrame:
    """(a, b), a < b: first candidate pairs of ``buckets``."""
    few = members.filter(F.col("c") <= SMALL)
    close = (few.select("key", F.col("lid").alias("a")).join(few.select("key", F.col("lid").alias("b")).hint("merge"), "key")
             .filter(F.col("a") < F.col("b")).select("a", "b"))
    star = (members.filter(F.col("c") > SMALL).select("lid", F.explode(F.array("centre", "near")).alias("other"))
            .filter(F.col("lid") != F.col("other")).select(*_pair("lid", "other")))
    return close.unionAll(star).distinct()


def prefixes(lids: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(lid, alone, hashes): the shingles of each line's prefix that another of the lines
    holds too, rarest first, and how many of the line's shingles come before them:
    those of one line only, which meet nothing."""
    sets = stored(texts.join(lids, "lid", "left_semi").select("lid", shingle_set("line", size).alias("hashes")))
    each = sets.select("lid", F.size("hashes").alias("g"), F.explode("hashes").alias("h"))
    # counted where its rows are, without a join
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter(F.col("n") > 1)
    ranked = (shared.groupBy("lid", "g")
              .agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("held")))
    length = F.col("g") - F.ceil(F.col("g") * F.lit(similarity) - F.lit(1e-9)) + 1
    alone = F.col("g") - F.size("held")
    take = F.greatest(length - alone, F.lit(0)).cast("int")
    return ranked.select("lid", alone.alias("alone"), F.slice("held", F.lit(1), take)["h"].alias("hashes"))


def spread_lines(large: DataFrame, first: DataFrame) -> DataFrame:
    """(key, centre, lid, g, d): the lines of the larger ``buckets`` beside their centres, with
    the size of the shingle set and the distance to the centre."""
    far = first.select("a", "b", "ga", "gb", (1 - F.col("jaccard")).alias("d"))
    return (large.select("key", "centre", "lid", *_pair("lid", "centre")).filter(F.col("a") != F.col("b")).join(far.hint("merge"), ["a", "b"])
            .select("key", "centre", "lid", F.when(F.col("lid") == F.col("a"), F.col("ga")).otherwise(F.col("gb")).alias("g"), "d"))


def open_lines(spread: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """``spread`` with the component ``part`` and whether the line is ``apart`` from its
    centre; without the lines that have no open pair in their bucket."""
    # a line linked to its centre is in the centre's component; open pairs have one end that is not
    known = (spread.join(label.withColumnRenamed("node", "lid").hint("merge"), "lid", "left")
             .select("key", "centre", "lid", "g", "d", F.coalesce("component", "lid").alias("part"),
                     (F.col("d") > 1 - similarity).alias("apart")))
    x_part = F.when(F.col("apart"), F.col("part"))
    sides = known.groupBy("key").agg(F.min(x_part).alias("x0"), F.max(x_part).alias("x1"),
                                     F.min("part").alias("y0"), F.max("part").alias("y1"))
    meets_x = (F.col("x0") != F.col("part")) | (F.col("x1") != F.col("part"))
    meets_y = (F.col("y0") != F.col("part")) | (F.col("y1") != F.col("part"))
    return (known.join(sides.filter(F.col("x0").isNotNull() & (F.col("y0") != F.col("y1"))), "key")
            .filter(meets_x | (F.col("apart") & meets_y)).select("key", "centre", "lid", "g", "d", "part", "apart"))


def small_groups(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``open_lines`` of the buckets with up to ``GROUP`` such lines, and of those with more."""
    many = known.groupBy("key").agg(F.count("*").alias("_lines")).filter(F.col("_lines") > GROUP)
    return known.join(many, "key", "left_anti"), known.join(many.select("key"), "key", "left_semi")


def all_open_pairs(known: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs inside the buckets of ``open_lines`` in different components, not
    excluded by set sizes or by the distances to the centre."""
    def side(name):
        return known.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("lid", "g", "d", "part", "apart")])
    return (side("x").filter("x_apart").join(side("y").hint("merge"), "key").filter(_open(similarity))
            .select(*_pair("x_lid", "y_lid")).distinct())


def _open(similarity: float) -> Column:
    once = ~F.col("y_apart") | (F.col("x_lid") < F.col("y_lid"))
    return ((F.col("x_part") != F.col("y_part")) & (F.least("x_g", "y_g") >= similarity * F.greatest("x_g", "y_g"))
            & (F.abs(F.col("x_d") - F.col("y_d")) <= 1 - similarity + 1e-9) & once)


def open_pairs(known: DataFrame, prefix: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs of ``open_lines`` in different components, not excluded by
    set sizes or by the distances to the centre, and with a shingle of both
    ``prefixes`` in common."""
    # buckets of one centre hold much the same lines: a line once for each centre, with its buckets
    lines = known.groupBy("centre", "lid", "g", "d", "part", "apart").agg(F.collect_set("key").alias("keys"))

    def side(frame, name):
        # a line meets its prefix as one row
        each = frame.join(prefix, "lid").select(*frame.columns, "alone", F.posexplode("hashes").alias("i", "h"))
        return each.withColumn("at", F.col("alone") + F.col("i") + 1).select(
            "centre", "h", *[F.col(c).alias(f"{name}_{c}") for c in ("lid", "g", "d", "part", "apart", "at", "keys")])
    # after their first common shingle two sets still need the others of a similar pair
    needed = (F.col("x_g") + F.col("y_g")) * F.lit(similarity / (1 + similarity)) - 1e-9
    ahead = 1 + F.least(F.col("x_g") - F.col("x_at"), F.col("y_g") - F.col("y_at"))
    return (side(lines.filter("apart"), "x").join(side(lines, "y"), ["centre", "h"])
            .filter(_open(similarity) & (ahead >= needed) & F.arrays_overlap("x_keys", "y_keys"))
            .select(*_pair("x_lid", "y_lid")).distinct())


def linked_lines(lines: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) over the lids of ``lines`` that have a link."""
    return linked_members(buckets(lines, size), lines, size, similarity)


def linked_members(members: DataFrame, lines: DataFrame, size: int = SHINGLE,
                   similarity: float = SIMILARITY) -> DataFrame:
    """``linked_lines`` from the ``buckets`` of the lines."""
    # what candidates need of their lines, fetched once
    texts = stored(lines.select("lid", "line").join(members.select("lid").distinct().hint("shuffle_hash"), "lid", "left_semi"))
    marked = stored(bitmaps(texts, size))
    large = members.filter(F.col("c") > SMALL)
    # the full value of a pair with a centre is kept: it bounds the pairs not compared
    centres = large.filter(F.col("lid") != F.col("centre")).select(*_pair("lid", "centre"))
    compared = not_excluded(candidates(members), marked, similarity).unionAll(centres).distinct()
    first = stored(similarities(compared, texts, size))
    links = first.filter(F.col("jaccard") >= similarity).select("a", "b")
    if large.isEmpty():
        return components(links)
    known = stored(open_lines(spread_lines(large, first), stored(components(links)), similarity))
    few, many = small_groups(known)
    prefix = stored(prefixes(many.select("lid").distinct(), texts, size, similarity))
    left = all_open_pairs(few, similarity).unionAll(open_pairs(many, prefix, similarity)).distinct()
    left = not_excluded(left, marked, similarity)
    rest = stored(similarities(left, texts, size).filter(F.col("jaccard") >= similarity).select("a", "b"))
    return components(links.unionAll(rest))


def dedup_lines(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that go taken out of the text, and the columns
    ``n_lines`` and ``n_kept`` (which replace columns of those names)."""
    lines = distinct_lines(docs, id_col, text_col)
    groups = stored(linked_lines(lines, size, similarity)).withColumnRenamed("node", "lid")
    # of a component the line with the first place stays; no two lines have one place
    placed = stored(lines.select("lid", "at").join(groups.hint("shuffle_hash"), "lid", "left").select("at", "component"))
    firsts = placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("at").alias("at"))
    kept = (placed.filter(F.col("component").isNull()).select("at").unionAll(firsts.select("at"))
            .groupBy(F.col("at.id").alias("_line_id"), F.col("at.th").alias("_line_th"))
            .agg(F.collect_list("at.pos").alias("_line_kept")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    rows = docs.select(*names, F.xxhash64(text_col).alias("_line_key"))
    met = rows.join(kept, rows[id_col].eqNullSafe(kept["_line_id"]) & (rows["_line_key"] == kept["_line_th"]), "left")
    cut = met.select(*names, F.split(F.col(text_col), "\n", -1).alias("_line_all"),
                     F.coalesce("_line_kept", F.array().cast("array<int>")).alias("_line_kept"))
    none = F.array().cast("array<int>")
    blank = F.when(F.size("_line_kept") == F.size("_line_all"), none).otherwise(
        F.filter(F.sequence(F.lit(0), F.size("_line_all") - 1), lambda i: _blank(F.get(F.col("_line_all"), i))))
    stay = cut.withColumn("_line_stay", F.when(F.col("_line_all").isNotNull(),
                                               F.sort_array(F.array_union("_line_kept", blank))))
    text = F.when(F.size("_line_stay") == F.size("_line_all"), F.col(text_col)).otherwise(
        F.array_join(F.transform("_line_stay", lambda i: F.get(F.col("_line_all"), i)), "\n"))
    return stay.select(*[text.alias(c) if c == text_col else F.col(c) for c in names],
                       F.when(F.col("_line_all").isNull(), F.lit(0)).otherwise(F.size("_line_all")).alias("n_lines"),
                       F.when(F.col("_line_stay").isNull(), F.lit(0)).otherwise(F.size("_line_stay")).alias("n_kept"))
