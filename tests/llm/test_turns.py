"""Conversation structure repair against exhaustive search and a row-by-row version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from mixlens.llm import turns

GAPS = ("", "u", "a", "ua", "au")
LEGAL = re.compile(r"(s?(ua)+)?")


def least(rows):
    """(cost, letters) over every combination of edits and up to two inserts a gap."""
    best = None
    choices = [("D",) if fault in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for _, fault in rows]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            initials, letters, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
            for (initial, fault), edit, gap in zip(rows, edits, gaps[1:]):
                initials += (initial if edit == "K" else edit[1:]) + gap
                letters += edit[0] + "I" * len(gap)
                cost += {"K": 0, "R": 3, "D": 4}[edit[0]] + 3 * len(gap) + (3 if fault == "truncated" and edit != "D" else 0)
            if LEGAL.fullmatch(initials) and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


def test_cheapest_is_exhaustive_least():
    rng = random.Random(5)
    for n in (0, 1, 2, 2, 3, 3, 3, 3):
        rows = [(rng.choice("suatx"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        assert turns.cheapest(rows) == least(rows), rows


def test_long_conversation_keeps_letters_in_place():
    rows = [("s", "")] + [("u", ""), ("a", "")] * 3000
    assert turns.cheapest(rows) == (0, "K" * 6001)
    assert turns.cheapest(rows + [("u", "")]) == (3, "K" * 6002 + "I")


def by_hand(rows):
    """The contract row by row, in plain Python."""
    out, held = {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        held[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    for conv, found in held.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in found:
            shown = text.strip(turns.BLANKS)
            faults.append((role[:1], "blank" if not shown else "duplicate" if (role, text) in seen else
                           "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t for t, _, _ in found if t is not None]
        cost, letters = turns.cheapest(faults)
        lines, at, state = [], 0, ""
        for letter in letters:
            if letter == "I" or letter == "R":
                role = "assistant" if state.endswith("u") else "user"
                lines.append(f"{role}:{found[at][2] if letter == 'R' else ''}")
                state += role[0]
            elif letter == "K":
                lines.append(f"{found[at][1]}:{found[at][2]}")
                state += found[at][1][0]
            at += letter != "I"
        assert LEGAL.fullmatch(state) and at == len(found)
        kinds = [f for _, f in faults]
        pairs = [a[0] + b[0] for a, b in zip(faults, faults[1:])]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"),
                     kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                     cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, alive string, pos int, audit string"


def made_rows():
    rng = random.Random(11)
    texts = ["Fine.", "Fine.", "Is it?", "cut off", "", " \t\n", "a\x0b.", "Ende!\r\n", "日本語", "x" * 5000 + ".", "line\nbreak.", None]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "Hello."), (None, None, "assistant", "Yes."), (None, 0, "user", "Hello.")]
    rows += [(700, None, "user", "No turn."), (700, 9, "assistant", "Nine."), (700, 4, "user", "Four."), (700, 4, None, None)]
    rows += [(800 + i, 1, "user", "One row.") for i in range(40)]          # some are dropped as a whole
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_report_equals_row_by_row(spark):
    rows = made_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    got = turns.repair_report(turns.damaged(df)).collect()
    want = by_hand(rows)
    assert len(got) == len(want) and any(w[6] == "" for w in want.values())
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_repaired_rows_are_real_outputs(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Ok.")],
                               "conv_id bigint, turn bigint, role string, text string")
    lines = turns.numbered(df)
    plan = turns.plans(lines)
    rows = sorted(map(tuple, turns.repaired(lines, plan).collect()))
    assert plan.first()["audit"] == "KIKK"
    assert rows == [(1, 0, "user", "Hi.", "K", 1), (1, 1, "assistant", "", "I", None), (1, 2, "user", "Again.", "K", 2),
                    (1, 3, "assistant", "Ok.", "K", 3)]


@pytest.mark.parametrize("rows", [[], [(1, 1, "system", None)]])
def test_empty_and_blank(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = turns.repair_report(df).collect()
    assert [(r["cost"], r["audit"], r["blank"]) for r in got] == [(4, "D", 1)] * len(rows)
