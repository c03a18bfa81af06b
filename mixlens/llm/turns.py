"""Conversation structure repair as a shortest path with one big integer per node.

The rows of a conversation are read in order.  Each row has at most one fault:
blank, duplicate (role and text seen earlier in the conversation) or truncated
(its last visible character ends no sentence).  The repaired conversation has
role initials ``(s?(ua)+)?``; edits are Keep (0), Rerole to user or assistant
(3), Delete (4; a must for blank and duplicate rows) and Insert of an empty
user or assistant row (3); a truncated row that stays costs 3 more.

The cheapest edits are found backwards over the four states of that pattern.
A node's value is one integer: the cost in the high digits, below it a field of
fixed width that holds the edit letters from here to the end, one octal digit a
letter, first letter highest, zeros after the last.  Putting a letter in front
moves the field down one digit.  So the smaller of two integers is the cheaper
path, and of equally cheap ones the path whose letters come first in ASCII;
nothing else decides.  The letters of the least integer fix every new role,
because each state lets only one of user and assistant follow.

Only flags and digests of rows (no texts) come together for the dynamic
program; texts then stream past the finished plan, so no conversation is held
whole.  The work for n rows of one conversation is n additions to integers of n
digits.

Defined results: NULL role or text counts as one blank; NULL turns come first
and count in no gap; rows of one turn are ordered by role and text; repeated
rows are duplicates; a NULL conv_id is one conversation; a role that does not
begin with s, u or a (an empty one too) is never kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}             # in ASCII order; 0 pads the end
#: states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FOLLOWS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage: by crc32("conv_id:turn") % 20 a row is dropped (0), emptied
    (1), loses its sentence marks (2), is repeated (3) or becomes a user row (4);
    NULLs are one blank.  ``alive`` is false for dropped rows, which stay as
    markers of their conversation."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), blank))
    hit = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                      (F.crc32(name.cast("binary")) % 20).alias("hit"))
    text = (F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("hit") != 0).alias("alive"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    ).drop("_copy")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, alive), stored: rows in conversation order,
    rows that are not alive first.  Without an ``alive`` column all rows are."""
    alive = F.coalesce("alive", F.lit(True)) if "alive" in rows.columns else F.lit(True)
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), alive.alias("alive"))
    order = Window.partitionBy("conv_id").orderBy("alive", F.col("turn").asc_nulls_first(), "role", "text")
    return stored(plain.withColumn("pos", F.row_number().over(order)))


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits for rows of (role initial, fault);
    fault is "blank", "duplicate", "truncated" or ""."""
    n = len(rows)
    # the cheapest path costs at most 4 a row and 3 more, so this many letters hold any inserts
    width = 3 * (n + (DELETE * n + INSERT) // INSERT + 2)
    field, top = (1 << width) - 1, width - 3
    worst = (DELETE * (n + 1) + REROLE * (n + 1)) << width

    def put(letter: str, cost: int, rest: int) -> int:
        return ((rest >> width) + cost << width) + (LETTERS[letter] << top) + ((rest & field) >> 3)

    def inserted(v: list[int]) -> list[int]:
        user, assistant = min(v[2], put("I", INSERT, v[3])), min(v[3], put("I", INSERT, v[2]))
        return [min(v[0], put("I", INSERT, user)), min(v[1], put("I", INSERT, user)), user, assistant]

    value = inserted([0, worst, worst, 0])
    for initial, fault in reversed(rows):
        before = []
        for state in range(4):
            best = put("D", DELETE, value[state])
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if (state, initial) in KEEPS:
                    best = min(best, put("K", more, value[KEEPS[state, initial]]))
                best = min(best, put("R", REROLE + more, value[FOLLOWS[state][1]]))
            before.append(best)
        value = inserted(before)
    names = {d: letter for letter, d in LETTERS.items()}
    digits = oct((value[0] & field) | (1 << width))[3:].rstrip("0")
    return value[0] >> width, "".join(names[int(d)] for d in digits)


def _conversations(batches, names):
    """Lists of rows, one list a conversation, from Arrow batches sorted by conversation."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]
        for row in zip(*columns):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``numbered`` rows: its faults (gaps, blank,
    duplicate, truncated, illegal), the least cost and the edit letters."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = F.rtrim("text", trim=F.lit(BLANKS))
    narrow = rows.select(
        "conv_id", "pos", "turn", "alive", F.substring("role", 1, 1).alias("initial"), (marks == "").alias("blank"),
        (~F.right(marks, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))

    def plan(batches):
        import pyarrow as pa
        out = []
        for key, found in _conversations(batches, ("conv_id", "turn", "alive", "initial", "blank", "cut", "digest")):
            seen, faults, turns, illegal, last = set(), [], [], 0, None
            for _, turn, alive, initial, blank, cut, digest in found:
                if not alive:
                    continue
                fault = "blank" if blank else "duplicate" if digest in seen else "truncated" if cut else ""
                seen.add(digest)
                faults.append((initial, fault))
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                if turn is not None:
                    turns.append(turn)
            cost, letters = cheapest(faults)
            kinds = [fault for _, fault in faults]
            out.append((key, turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, kinds.count("blank"),
                        kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, letters))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(rows.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = f"conv_id {kind}, " + ", ".join(f"{name} bigint" for name in names[1:-1]) + ", audit string"
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(plan, schema)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place, role, text, edit, pos) of ``numbered``
    rows under their ``plans``; ``pos`` is NULL for inserted rows.  Partitions
    hold whole conversations, rows in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None)
    lines = rows.filter("alive").select("conv_id", "pos", "role", "text", none.cast("string").alias("audit")).unionAll(
        plan.select("conv_id", F.lit(0).alias("pos"), none.cast("string"), none.cast("string"), "audit"))

    def edit(batches):
        import pyarrow as pa
        letters, at, state, place, key = "", 0, 0, 0, None
        for batch in batches:
            out = []

            def insert():
                nonlocal at, state, place
                while at < len(letters) and letters[at] == "I":
                    role, state = FOLLOWS[state]
                    out.append((key, place, role, "", "I", None))
                    at, place = at + 1, place + 1

            for conv, pos, role, text, audit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if audit is not None:
                    letters, at, state, place, key = audit, 0, 0, 0, conv
                    insert()
                    continue
                letter, at = letters[at], at + 1
                if letter == "K":
                    state = KEEPS[state, role[:1]]
                elif letter == "R":
                    role, state = FOLLOWS[state]
                if letter != "D":
                    out.append((conv, place, role, text, letter, pos))
                    place += 1
                insert()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = ["conv_id", "place", "role", "text", "edit", "pos"]
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(
        edit, f"conv_id {kind}, place bigint, role string, text string, edit string, pos int")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows straight from ``repaired``: SHA-256 of
    "role:text" lines joined by newlines, fed row by row."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        import pyarrow as pa
        state, key, out = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                 for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    state, key = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["conv_id", "repaired_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], types[0]), pa.array([state.hexdigest()], types[1])],
                                             names=["conv_id", "repaired_sha256"])

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(lines.schema["conv_id"].dataType), pa.string()]
    return lines.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """``plans`` of every conversation with the digest of its repaired rows."""
    lines = numbered(rows)
    plan = stored(plans(lines))
    found = digests(repaired(lines, plan)).withColumnRenamed("conv_id", "_conv")
    nothing = hashlib.sha256(b"").hexdigest()
    return plan.join(found, plan["conv_id"].eqNullSafe(found["_conv"]), "left").select(
        *plan.columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
