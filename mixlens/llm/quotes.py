"""Chat formatting by quotation linking.

Each message is parsed into its own text and its quoted passages by nesting
level (lines that begin with ``>`` signs, an attribution line above them goes
with them).  Normalised passages, and their lines, are hashed and joined to the
hashes of what other messages wrote themselves: whole texts, paragraphs and
lines, each hash reduced before the join to its first message of the
conversation and to those of the smallest and the largest conversation of the
table, so a phrase that everybody writes meets one row.  The original is the
first earlier message of the own conversation that wrote it, else that of the
smallest conversation, or of the largest where the own one is the smallest.  Parts
shorter than ``LEAST_CHARS`` are matched inside the conversation only.  A
message answers the message of which it quotes most at level 1, else at the
next deeper level that another message wrote (equally much: the smaller conversation,
then turn), else the one before it in its conversation.

Answers so found may run in a circle through several conversations.  Pointer
doubling over the conversations that quote each other finds the circles; in each,
the quotation of its smallest (conversation, turn) is dropped and the message
answers the one before it, until no circle is left.  Conversations joined by
quotation form one thread.  A thread of several conversations is ordered by
reply depth, then conversation and turn, a single conversation by turn; so
every answer follows what it answers.

Defined results: NULL text counts as empty; a message with NULL conversation
or turn stands alone (no thread, parent or position); rows that repeat
conversation and turn are ordered by role and text and are answered as one;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import stored
from mixlens.llm.components import components

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"(wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$")
LEAST_CHARS = 12           # shorter passages and lines identify a message only inside its conversation

PARSED = ("own string, max_level int, n_quoted_lines int, "
          "passages array<struct<level:int,hash:bigint,size:int>>, units array<struct<hash:bigint,size:int>>")


def normal(text: str) -> str:
    """Lower case, white space as single blanks, none at the ends."""
    return " ".join(text.lower().split())


def parse(text: str | None):
    """(own text, deepest level, quoted lines, [(level, passage)]) of one message.
    A passage is a run of lines of one level; blank quoted lines belong to it."""
    own, passages, quoted, deepest = [], [], 0, 0
    run_level, run = 0, []

    def close():
        if run_level and any(s.strip() for s in run):
            passages.append((run_level, "\n".join(run)))

    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m.group(1).count(">") if m else 0
        if level != run_level:
            close()
            if level and not run_level and own and ATTRIBUTION.search(own[-1]):
                own.pop()
            run_level, run = level, []
        if level:
            quoted += 1
            deepest = max(deepest, level)
            run.append(line[m.end():])
        else:
            own.append(line)
    close()
    return "\n".join(own).strip("\n"), deepest, quoted, passages


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest
    h = xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def units(text: str) -> dict[int, int]:
    """hash -> length of what may be quoted from a text: the whole, its
    paragraphs and its lines, normalised."""
    out = {}
    for part in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]:
        shown = normal(part)
        if shown:
            out[_hash(shown)] = len(shown)
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role) with the parsed parts of each message."""
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
        part = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32())]))
        for batch in batches:
            own, deepest, quoted, passages, wrote = [], [], [], [], []
            for cell in batch.column(3):
                o, d, q, p = parse(cell.as_py())
                own.append(o)
                deepest.append(d)
                quoted.append(q)
                passages.append([{"level": level, "hash": h, "size": n}
                                 for level, passage in p for h, n in units(passage).items()])
                wrote.append([{"hash": h, "size": n} for h, n in units(o).items()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(own, pa.string()), pa.array(deepest, pa.int32()),
                 pa.array(quoted, pa.int32()), pa.array(passages, kind), pa.array(wrote, part)],
                names=["conv_id", "turn", "role", "own", "max_level", "n_quoted_lines", "passages", "units"])
    return (messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                            F.col("role").cast("string"), F.col("text").cast("string"))
            .mapInArrow(run, "conv_id bigint, turn bigint, role string, " + PARSED))


def quoted_parents(parts: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn): per message with a quote that
    another message wrote, the one from which it quotes most at the first level
    that has any."""
    wrote = (parts.select("conv_id", "turn", F.explode("units").alias("u"))
             .select("conv_id", "turn", F.col("u.hash").alias("hash"), F.col("u.size").alias("size")))
    here = wrote.groupBy("conv_id", "hash").agg(F.min("turn").alias("here_turn"))
    place = F.struct("conv_id", "turn")
    anywhere = (wrote.filter(F.col("size") >= LEAST_CHARS).groupBy("hash")
                .agg(F.min(place).alias("first"), F.max(F.struct("conv_id", (-F.col("turn")).alias("t"))).alias("last")))
    quotes = (parts.select("conv_id", "turn", F.explode("passages").alias("q"))
              .select("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.hash").alias("hash"),
                      F.col("q.size").alias("size"))
              .groupBy("conv_id", "turn", "level", "hash").agg(F.max("size").alias("size")))
    met = quotes.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    own = F.when(F.col("here_turn") < F.col("turn"), F.struct("conv_id", F.col("here_turn").alias("turn")))
    other = (F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first"))
             .when(F.col("last.conv_id") != F.col("conv_id"),
                   F.struct(F.col("last.conv_id").alias("conv_id"), (-F.col("last.t")).alias("turn"))))
    source = met.withColumn("source", F.coalesce(own, other)).filter(F.col("source").isNotNull())
    votes = source.groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("size"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (-F.col("size")).alias("s"), F.col("source.conv_id").alias("c"), F.col("source.turn").alias("t"))).alias("best"))
    return best.select("conv_id", "turn", F.col("best.c").alias("parent_conv"), F.col("best.t").alias("parent_turn"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``place`` 0, 1, ... of each row in its key by ``order``.  Rows are
    range-partitioned by key and order, so a hot key is split; each partition's
    share of a key is shifted by the shares before it."""
    run = stored(rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order)
                 .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    shares = run.groupBy(F.col(key), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (run.withColumn("_part", part).join(shares, [key, "_part"])
            .withColumn("place", F.col("_at") - F.col("_first") + F.col("_shift"))
            .drop("_at", "_part", "_first", "_shift"))


def _message(conv: str = "conv_id", turn: str = "turn") -> Column:
    return F.when(F.col(conv).isNotNull(), F.struct(F.col(conv).alias("conv_id"), F.col(turn).alias("turn")))


def reply_depths(parents: DataFrame) -> DataFrame:
    """(node, up, depth, low) from (node, parent), by pointer doubling: ``up`` is NULL
    and ``depth`` the number of answers up to the root, unless the way up ends in a
    circle; there ``low``, the least node on the way, is the node itself for the
    least node of the circle alone.  Rounds: log2 of the longest way."""
    now = stored(parents.select("node", F.col("parent").alias("up"), F.col("parent").alias("low"),
                                F.col("parent").isNotNull().cast("bigint").alias("depth")))
    reach, before = 1, None
    while True:
        left = now.filter(F.col("up").isNotNull()).count()
        # a round that ends no way leaves only ways into circles, none longer than their nodes
        if not left or (left == before and reach >= left):
            return now
        before, reach = left, reach * 2
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"), F.col("depth").alias("_depth"))
        moved = now.filter(F.col("up").isNotNull()).join(above, "up").select(
            "node", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), (F.col("depth") + F.col("_depth")).alias("depth"))
        now = stored(now.filter(F.col("up").isNull()).select("node", "up", "low", "depth").unionAll(moved))


def without_circles(links: DataFrame, default: DataFrame):
    """``links`` (conv_id, turn, parent_conv, parent_turn) less the quotations that close
    a circle, and (node, depth) of the messages whose conversations quote each other
    (None where none do).  ``default``: (conv_id, turn, _previous) of every message.

    The least node of a circle answers another conversation: any answer inside its
    own goes to a smaller turn.  Each round drops at least one link, so the rounds end."""
    while True:
        cross = links.filter(F.col("conv_id") != F.col("parent_conv"))
        if cross.isEmpty():
            return links, None
        linked = cross.select("conv_id").unionAll(cross.select(F.col("parent_conv").alias("conv_id"))).distinct()
        nodes = (default.join(linked, "conv_id", "left_semi").join(links, ["conv_id", "turn"], "left")
                 .withColumn("_conv", F.when(F.col("_previous").isNotNull(), F.col("conv_id")))
                 .select(_message().alias("node"), F.coalesce(_message("parent_conv", "parent_turn"), _message("_conv", "_previous")).alias("parent")))
        found = reply_depths(nodes)
        closing = found.filter(F.col("up").isNotNull() & (F.col("low") == F.col("node"))).select("node.conv_id", "node.turn")
        if closing.isEmpty():
            return links, found.select("node", "depth")
        links = stored(links.join(closing, ["conv_id", "turn"], "left_anti"))


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text (without quotes), n_quoted_lines,
    max_level, parent_conv, parent_turn, quoted (the parent was found by its
    quotation), thread_id, position (in the thread, from 0)."""
    parts = stored(parsed(messages))
    shown = ["conv_id", "turn", "role", "own", "max_level", "n_quoted_lines"]
    inside = parts.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    links = stored(quoted_parents(inside))
    placed = stored(numbered(inside.select(*shown), "conv_id", ["turn", "role", "own"]))
    # the message before, as the default parent: the last turn that differs
    turns = placed.groupBy("conv_id", "turn").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    previous = turns.select("conv_id", F.col("turn").alias("_previous"), (F.col("_last") + 1).alias("_first"))
    default = stored(turns.join(previous, ["conv_id", "_first"], "left").select("conv_id", "turn", "_previous"))
    links, depths = without_circles(links, default)
    ordered = placed.withColumn("thread_id", F.col("conv_id"))
    if depths is not None:
        threads = stored(components(links.filter(F.col("conv_id") != F.col("parent_conv"))
                                    .select(F.col("conv_id").alias("a"), F.col("parent_conv").alias("b")))
                         .select(F.col("node").alias("conv_id"), F.col("component").alias("thread_id")))
        joined = (placed.drop("place").join(threads, "conv_id")
                  .join(depths.select("node.conv_id", "node.turn", "depth"), ["conv_id", "turn"]))
        joined = numbered(joined, "thread_id", ["depth", "conv_id", "turn", "role", "own"])
        ordered = ordered.join(threads, "conv_id", "left_anti").unionByName(joined.drop("depth"))
    linked = (ordered.join(default, ["conv_id", "turn"]).join(links, ["conv_id", "turn"], "left")
              .select("conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted_lines", "max_level",
                      F.coalesce("parent_conv", F.when(F.col("_previous").isNotNull(), F.col("conv_id"))).alias("parent_conv"),
                      F.coalesce("parent_turn", "_previous").alias("parent_turn"),
                      F.col("parent_conv").isNotNull().alias("quoted"), "thread_id",
                      F.col("place").alias("position")))
    nothing = F.lit(None).cast("bigint")
    alone = parts.filter(F.col("conv_id").isNull() | F.col("turn").isNull()).select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted_lines", "max_level",
        nothing.alias("parent_conv"), nothing.alias("parent_turn"), F.lit(False).alias("quoted"),
        nothing.alias("thread_id"), nothing.alias("position"))
    return linked.unionAll(alone)
