"""Operators 1 and 6, and the pipeline's stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixlens.llm import quality, quotes
from mixlens.llm.queries import op1_quality, op6_quotation
from tests.llm.helpers import DATA, edge_docs, empty_docs, roots, sample_docs
from tests.llm.test_dedup import brute_simhash

SF01 = "/root/testdata/sf0.01"


def test_quality_query_on_held_out_labels(spark):
    out = op1_quality(spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97
    assert out.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_vote_is_exact_and_blocks_agree():
    rng = np.random.default_rng(1)
    known = rng.standard_normal((40, 8))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    v = rng.standard_normal((33, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5] = 0
    label, weight = rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.5
    got = quality.vote(v, known, label, weight, 0.6, neighbours=5, block=7)
    for k in range(33):
        cos = known @ v[k]
        near = np.argsort(-cos, kind="stable")[:5]
        pull = np.clip(cos[near], 0, 1) ** quality.SHARPNESS * weight[near]
        want = 0.6 if not v[k].any() or pull.sum() <= 1e-12 else (pull * label[near]).sum() / pull.sum()
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 1), (13, 0), (14, 0), (None, 1), (8, None), (9, 7), (5, 0)],
                                   "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns)          # score replaces the column of that name
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    prior = model[4]
    assert all(r.score == pytest.approx(prior) for r in rows if not r.text)
    assert quality.fit(docs, labels.filter("false")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(empty_docs(spark), model).count() == 0


def test_parse_nested_quotes():
    text = "I agree.\nAnna wrote:\n> yes, it was late\n> > were you there\n> >  yesterday\n>\n> so it goes\nBye"
    own, deepest, n, passages = quotes.parse(text)
    assert own == "I agree.\nBye" and (deepest, n) == (2, 5)
    assert passages == [(1, "yes, it was late"), (2, "were you there\n yesterday"), (1, "\nso it goes")]
    assert quotes.parse(None) == ("", 0, 0, []) and quotes.parse("") == ("", 0, 0, [])
    assert quotes.parse(">>> deep")[1] == 3


def turns():
    return [(1, 0, "user", "How do I grow tomatoes at home?"), (1, 1, "assistant", "Use a sunny place and water often."),
            (1, 2, "user", "> How do I grow tomatoes\n> at home?\nAnd in the winter months?"),
            (2, 0, "user", "> Use a SUNNY place   and water often.\nThat did not work for me."),
            (2, 1, "assistant", "Sorry to hear that, truly."), (3, 0, "user", "Another matter entirely, my friends."),
            (3, 1, "user", "> nobody ever wrote this sentence\nWell."), (4, 0, "user", "> short\nshort"),
            (5, 0, None, None), (5, 0, None, None), (None, 0, "user", "> How do I grow tomatoes at home?"),
            (6, None, "user", "text"), (6, 4, "user", "> >> x\n" + "long " * 20000)]


def test_conversations(spark):
    rows = turns()
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, own string")
    out = quotes.conversations(frame).collect()
    assert len(out) == len(rows)
    at = {(r.conv_id, r.turn): r for r in out}
    assert (at[1, 2].parent_conv, at[1, 2].parent_turn, at[1, 2].quoted) == (1, 0, True)
    assert at[1, 2].text == "And in the winter months?" and at[1, 2].n_quoted_lines == 2
    assert (at[2, 0].parent_conv, at[2, 0].parent_turn, at[2, 0].quoted, at[2, 0].thread_id) == (1, 1, True, 1)
    assert (at[2, 1].parent_conv, at[2, 1].parent_turn, at[2, 1].quoted) == (2, 0, False)
    assert (at[3, 1].parent_turn, at[3, 1].quoted) == (0, False) and at[4, 0].parent_conv is None
    assert [at[1, t].position for t in range(3)] + [at[2, t].position for t in range(2)] == [0, 1, 2, 3, 4]
    assert sorted(r.position for r in out if r.conv_id == 5) == [0, 1]
    assert at[None, 0].thread_id is None and at[6, None].position is None
    assert quotes.conversations(frame.filter("false")).count() == 0


def test_deep_and_short_quotes_link(spark):
    rows = [(1, 0, "Where shall we meet on Sunday?"), (1, 1, "Yes, agreed\nBye"), (1, 2, "Something else altogether."),
            (1, 3, "> Yes, agreed\nGood."), (1, 4, ">> Where shall we meet on Sunday?\nAt noon."),
            (1, 5, "> nobody wrote this here\n>> Where shall we meet on Sunday?\nWell."),
            (1, 6, "> Something else altogether.\n>> Where shall we meet on Sunday?\nYes."),
            (2, 0, "Hello to all of you."), (2, 1, "> Yes, agreed\nNo.")]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    at = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn, r.quoted) for r in quotes.conversations(frame).collect()}
    assert [at[1, t] for t in (3, 4, 5, 6)] == [(1, 1, True), (1, 0, True), (1, 0, True), (1, 2, True)]
    assert at[2, 1] == (2, 0, False)         # a short part says nothing outside its conversation


def brute_threads(rows):
    """{(conv, turn): (parent, quoted, thread, position)} of (conv, turn, text) rows, one a turn."""
    own, quoted = {}, {}
    for c, t, x in rows:
        o, _, _, passages = quotes.parse(x)
        own[c, t] = quotes.units(o)
        parts = {}
        for level, p in passages:
            for h, n in quotes.units(p).items():
                parts.setdefault(level, {})[h] = n
        quoted[c, t] = parts
    before = {(c, t): max(((c, u) for d, u, _ in rows if d == c and u < t), default=None) for c, t, _ in rows}
    link = {}
    for m, parts in quoted.items():
        for level in sorted(parts):
            votes = {}
            for h, n in parts[level].items():
                here = [k for k in own if k[0] == m[0] and k[1] < m[1] and h in own[k]]
                some = sorted(k for k in own if h in own[k] and own[k][h] >= quotes.LEAST_CHARS)
                source = min(here) if here else None
                if source is None and some and some[0][0] != m[0]:
                    source = some[0]
                elif source is None and some and some[-1][0] != m[0]:
                    source = min(k for k in some if k[0] == some[-1][0])
                if source is not None:
                    votes[source] = votes.get(source, 0) + n
            if votes:
                link[m] = min(votes, key=lambda k: (-votes[k], k))
                break
    while True:
        up = {m: link.get(m, before[m]) for m in own}
        least = set()
        for m in own:
            way, k = [], up[m]
            while k is not None and k not in way:
                way.append(k)
                k = up[k]
            if m in way and m == min(way):
                least.add(m)
        if not least:
            break
        for m in least:
            del link[m]
    group = {c: c for c, _ in own}

    def head(c):
        while group[c] != c:
            c = group[c]
        return c
    for m, k in link.items():
        a, b = sorted((head(m[0]), head(k[0])))
        group[b] = a
    many = {c for m, k in link.items() if m[0] != k[0] for c in (m[0], k[0])}

    def depth(m):
        return 0 if up[m] is None else 1 + depth(up[m])
    out = {}
    for thread in {head(c) for c in group}:
        inside = [m for m in own if head(m[0]) == thread]
        for at, m in enumerate(sorted(inside, key=lambda m: (depth(m) if m[0] in many else 0, m))):
            out[m] = (up[m], m in link, thread, at)
    return out


def test_threads_by_brute_force(spark):
    import random
    rng = random.Random(5)
    names = ["alpha", "bravo", "carol", "delta", "echo", "fox"]
    rows = []
    for c in range(1, 41):
        for t in range(rng.randint(1, 6)):
            said = [f"message {c}/{t} about {rng.choice(names)} and more"] + ["we all say this sentence often"] * (rng.random() < 0.2)
            lines = []
            if rng.random() < 0.5:                      # of any conversation, smaller or larger, or not existing
                d, u = rng.randint(1, 42) if rng.random() < 0.6 else c, rng.randint(0, 2)
                mark = "> " * rng.choice([1, 1, 2, 3])
                lines = [f"{mark}message {d}/{u} about {n} and more" for n in rng.sample(names, 5)]
            if rng.random() < 0.1:
                lines.append("> we all say this sentence often")
            rows.append((c, t, "\n".join(lines + said)))
    # two rings, one of them through the middle of its conversations
    rows += [(50, 0, "> words of the third one here\nwords of the first one here"), (51, 0, "> words of the first one here\nwords of the second one here"),
             (52, 0, "> words of the second one here\nwords of the third one here"),
             (60, 0, "start of conversation sixty"), (60, 1, "> what sixty-one says on this\nwhat sixty says on this"),
             (61, 0, "> what sixty says on this\nstart of sixty-one"), (61, 1, "what sixty-one says on this")]
    want = brute_threads(rows)
    assert sum(q and p[0] > m[0] for m, (p, q, _, _) in want.items()) > 5      # originals in larger conversations too
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (None if r.parent_conv is None else (r.parent_conv, r.parent_turn), r.quoted, r.thread_id, r.position)
           for r in quotes.conversations(frame.repartition(7)).collect()}
    assert got == want
    assert want[50, 0][:2] == (None, False) and want[60, 1][:2] == ((60, 0), False) and want[61, 0][:2] == ((60, 1), True)


def test_every_answer_follows_its_parent(spark):
    out = op6_quotation(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    assert len(out) == len(rows)
    at = {(r.conv_id, r.turn): r for r in out}
    for conv in {r.conv_id for r in rows}:
        order = sorted(r.turn for r in rows if r.conv_id == conv)
        for a, b in zip([None, *order], order):
            r = at[conv, b]
            assert r.quoted or (r.parent_turn, r.parent_conv) == (a, None if a is None else conv)
    for r in out:
        if r.parent_conv is not None:
            p = at[r.parent_conv, r.parent_turn]
            assert p.thread_id == r.thread_id and p.position < r.position


def test_pipeline_stages(spark):
    docs = sample_docs(spark)
    one = corpus_pipeline.quality_filter(spark, docs, DATA)
    scores = {r.doc_id: r.predicted for r in op1_quality(spark, DATA).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, p in scores.items() if p}
    two = corpus_pipeline.line_dedup(spark, docs, DATA)
    assert two.schema.names == docs.schema.names and two.count() == docs.count()
    assert two.filter(F.length("text") != F.col("n_chars")).count() == 0
    three = corpus_pipeline.near_duplicates(spark, docs, DATA)
    _, comp = brute_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for c in comp.values()})
    assert three.columns == docs.columns
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("frame", [edge_docs, empty_docs])
def test_pipeline_edges(spark, frame):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.collect()
    corpus_pipeline.pack(spark, docs, DATA).collect()


def test_pipeline_keeps_one_of_repeated_rows_and_all_without_labels(spark, tmp_path):
    long = " ".join(f"word{i} stands here" for i in range(60))
    other = " ".join(f"quite another sentence number {i}" for i in range(60))
    rows = [(7, long, 1), (7, long, 2), (3, long + " end", 3), (None, other, 4), (None, other, 5), (None, "alone " * 40, 6), (9, other, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keys int").repartition(3)
    kept = sorted(((r.doc_id, r["keys"]) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()), key=repr)
    assert kept == [(3, 3), (9, 7), (None, 6)]
    # one of two rows alike in everything but a further column, and of two without an id
    kept = corpus_pipeline.near_duplicates(spark, docs.filter("keys in (1, 2, 4, 5)"), DATA).collect()
    assert sorted(r["keys"] in (1, 2) for r in kept) == [False, True]
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).count() == len(rows)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    # repeated lines go in the line stage, so which near copies remain is that stage's doing; no document is lost for want of labels
    assert packed.count() >= 3


def test_sample_holds_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, None), (2, None), (3, "c")] + [(4, "x")] * 50,
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id bigint, quality int")
    got = {(r["_id"], r.text) for r in quality.sampled(docs, labels, 10, "doc_id", "text", "quality").collect()}
    out = quality.sampled(docs, labels, 10, "doc_id", "text", "quality")
    held = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert got == {(i, t) for i, t in ((1, "a"), (2, None), (3, "c"), (4, "x")) if i not in held} and out.count() == len(got)
