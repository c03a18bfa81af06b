"""Operators 2, 3, 7, 8 and the components against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mixlens.llm import components as union_find
from mixlens.llm import embed, lines, mih, simhash
from mixlens.llm.components import components
from mixlens.llm.queries import op2_line_dedup, op3_embedding_dedup, op7_topk, op8_simhash
from tests.llm.helpers import DATA, edge_docs, empty_docs, roots, sample_docs, words


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots({x for p in links if p[0] != p[1] for x in p}, links)
    assert got == want
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def test_many_links_are_not_broadcast(spark, monkeypatch):
    links = spark.range(400).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    for step in (union_find._large_star, union_find._small_star):
        plan = step(links, False)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    monkeypatch.setattr(union_find, "FEW", 100)
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(401)}


# ---- lines -------------------------------------------------------------------

def shingle_set(line, size=lines.SHINGLE):
    return {line[i:i + size] for i in range(len(line) - size + 1)} or {line}


def brute_lines(rows):
    """Places (id, position) of the lines that stay, by comparing all distinct lines that
    share a band key; the number of links; and the similar pairs that share none."""
    places = {}
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip():
                places.setdefault(line, []).append((doc_id, k))
    uniq = list(places)
    sets, keys = [shingle_set(x) for x in uniq], [set(k) for k in lines.signatures(uniq)[0].tolist()]
    links = [(i, j) for i in range(len(uniq)) for j in range(i)
             if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    met = [(i, j) for i, j in links if keys[i] & keys[j]]
    comp = roots(range(len(uniq)), met)
    first = {}
    for i, line in enumerate(uniq):
        first[comp[i]] = min(first.get(comp[i], (10**18, 0)), min(places[line]))
    return set(first.values()), len(links), [p for p in links if p not in met]


def line_corpus(n=60):
    rng = random.Random(7)
    vocab = words(rng, 300)
    base = [" ".join(rng.choices(vocab, k=rng.randint(3, 60))) for _ in range(120)]
    docs = []
    for d in range(n):
        part = []
        for line in rng.sample(base, 6):
            w = line.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            part.append(" ".join(w))
        docs.append((d, "\n".join([*part, "", " ".join(rng.choices(vocab, k=12))])))
    return docs


def test_lines_against_brute_force(spark):
    docs = line_corpus()
    kept, links, missed = brute_lines(docs)
    assert links > 50 and len(missed) <= 0.02 * links
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    got = {r.doc_id: r.text for r in out}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (d, k) in kept) for d, t in docs}
    assert got == want


def test_large_buckets_lose_no_link(spark):
    """Many variants of one long line fall into one bucket; the centre alone does not link them all."""
    rng = random.Random(11)
    vocab = words(rng, 400)
    base = rng.choices(vocab, k=60)
    docs = []
    for d in range(80):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 5)):
            w[k] = rng.choice(vocab)
        docs.append((d, " ".join(w)))
    kept, _, _ = brute_lines(docs)
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, 0) for r in out if r.text} == kept


def test_every_pair_of_a_large_bucket_is_decided(spark):
    """Twins far from the centre, each with a fine key of its own, are linked."""
    rng = random.Random(5)
    rows, texts, want = [], [], set()
    for i in range(30):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=150))
        for lid, text in ((i, line), (100 + i, line + " x")):
            texts.append((lid, text))
            rows.append((7, 60, lid, 29, lid))
        want.add((i, 100 + i))
    members = spark.createDataFrame(rows, "key bigint, c bigint, lid bigint, centre bigint, near bigint")
    found = lines.linked_members(members, spark.createDataFrame(texts, "lid bigint, line string"))
    assert {(r.component, r.node) for r in found.collect() if r.node != r.component} == want


def test_a_family_near_the_threshold_sends_few_pairs(spark):
    """Copies that share three quarters and differ in the rest: one bucket, hardly any pair
    left for the exact comparison, none of the similar ones among those not compared."""
    rng = random.Random(17)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(10**6)) for _ in range(60)]
    texts = []
    for lid in range(300):
        w = list(base)
        for k in rng.sample(range(60), 6):
            w[k] = str(rng.randrange(10**8))
        texts.append((lid, " ".join(w)))
    sets = [shingle_set(t) for _, t in texts]
    members = spark.createDataFrame([(7, 300, lid, 0, lid) for lid in range(300)],
                                    "key bigint, c bigint, lid bigint, centre bigint, near bigint")
    frame = spark.createDataFrame(texts, "lid bigint, line string")
    first = lines.similarities(lines.candidates(members), frame, lines.SHINGLE)
    label = lines.components(first.filter(F.col("jaccard") >= 0.8).select("a", "b"))
    known = lines.open_lines(lines.spread_lines(members, first), label, 0.8)
    prefix = lines.prefixes(known.select("lid"), frame, lines.SHINGLE, 0.8)
    sent = {(r.a, r.b) for r in lines.open_pairs(known, prefix, 0.8).collect()}
    comp = {r.node: r.component for r in label.collect()}
    similar = {(a, b) for b in range(300) for a in range(b) if comp.get(a, a) != comp.get(b, b) and 0 not in (a, b)
               and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert similar <= sent
    assert len(sent) < 0.02 * 300 * 299 / 2


def test_members_of_buckets_are_not_broadcast(spark):
    members = spark.range(60).select((F.col("id") % 20).alias("key"), F.lit(3).cast("bigint").alias("c"), F.col("id").alias("lid"),
                                     (F.col("id") % 20).alias("centre"), (F.col("id") % 20).alias("near"))
    known = members.select("key", "centre", "lid", F.lit(9).alias("g"), F.lit(0.5).alias("d"), F.col("lid").alias("part"), F.lit(True).alias("apart"))
    for step in (lines.candidates(members), lines.all_open_pairs(known, 0.8)):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.a, r.b) for r in lines.candidates(members).collect()} == {
        (a, b) for a in range(60) for b in range(a + 1, 60) if (b - a) % 20 == 0}


def test_bitmaps_exclude_no_similar_pair(spark):
    """Of variants of one line, also with repeated shingles and of other lengths, the bitmaps
    leave every similar pair, and few of the others."""
    rng = random.Random(23)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé日", k=6)) for _ in range(50)]
    texts = ["", "short", "shorter", "ab " * 200, "ab " * 150, "ab " * 200 + "x"]
    for changed in [0, 1, 2, 3, 5, 8, 20] * 12:
        w = list(base)
        for k in rng.sample(range(50), changed):
            w[k] = "".join(rng.choices("abcdefghijklmnop", k=6))
        texts.append(" ".join(w[:rng.choice([50, 50, 45, 30])]))
    texts = list(dict.fromkeys(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "lid bigint, line string")
    marked = lines.bitmaps(frame)
    pairs = frame.select(F.col("lid").alias("a")).crossJoin(frame.select(F.col("lid").alias("b"))).filter("a < b")
    left = {(r.a, r.b) for r in lines.not_excluded(pairs, marked, 0.8).collect()}
    sets = [shingle_set(t) for t in texts]
    assert {r.lid: r.windows for r in marked.collect()} == {i: max(len(t) - 9, 1) for i, t in enumerate(texts)}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    every = len(sets) * (len(sets) - 1) // 2
    assert similar <= left and len(similar) > 50
    assert len(left - similar) < 0.4 * (every - len(similar))


def test_prefixes_are_for_large_groups_only(spark):
    """Buckets with up to GROUP lines of open pairs need no count of shingles, and both
    ways find the pairs that brute force finds."""
    rng = random.Random(29)
    texts, rows, lid = [], [], 0
    for key, count in ((1, 12), (2, lines.GROUP), (3, lines.GROUP + 20)):
        centre = lid
        for i in range(count // 2):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120))
            for text in (line, line + " x"):
                texts.append((lid, text))
                rows.append((key, count, lid, centre, lid))
                lid += 1
    members = spark.createDataFrame(rows, "key bigint, c bigint, lid bigint, centre bigint, near bigint")
    frame = spark.createDataFrame(texts, "lid bigint, line string")
    first = lines.similarities(lines.candidates(members), frame, lines.SHINGLE)
    label = lines.components(first.filter(F.col("jaccard") >= 0.8).select("a", "b"))
    few, many = lines.small_groups(lines.open_lines(lines.spread_lines(members, first), label, 0.8))
    assert {r.key for r in few.collect()} == {1, 2} and {r.key for r in many.collect()} == {3}
    # shingles are counted without a join, and a line joins its prefix as one row
    prefix = lines.prefixes(many.select("lid").distinct(), frame, lines.SHINGLE, 0.8)
    plan = prefix._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan, plan
    held = [r.lid for r in prefix.collect()]
    assert len(held) == len(set(held)) >= lines.GROUP
    found = lines.linked_members(members, frame)
    assert {(r.component, r.node) for r in found.collect() if r.node != r.component} == {(i, i + 1) for i in range(0, lid, 2)}


def near_lines(rng):
    """Pairs of one kind of line that differ in short fields only."""
    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    def token(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))

    def fields(head, tail, change):
        other = list(head)
        for k in change:
            other[k] = number(len(other[k]))
        return " ".join([*head, tail]), " ".join([*other, tail])
    long = " ".join(token(20) for _ in range(7))
    return {"link": fields([number(2) for _ in range(12)], "https://" + token(130), [rng.randrange(12)]),
            "log": fields([number(2) for _ in range(11)], "id=" + token(260), rng.sample(range(11), 2)),
            "table": (("| 1 | 22 | " + (row := " | ".join(token(6) for _ in range(24)))), "| 7 | 22 | " + row),
            "code": ("    if x == 1 : " + (call := f"return {token(70)}({token(40)})"), "    if x == 2 : " + call),
            "words": (long, long + " a b c d")}


def test_lines_of_short_fields_meet(spark):
    rng, rows, kinds = random.Random(13), [], []
    for _ in range(100):
        for kind, pair in near_lines(rng).items():
            a, b = map(shingle_set, pair)
            if len(a & b) >= 0.8 * len(a | b):
                rows += [(len(kinds), line) for line in pair]
                kinds.append(kind)
    keys = lines.signatures([line for _, line in rows])[0].tolist()
    met, all_ = {}, {}
    for i, kind in enumerate(kinds):
        a, b = (set(k) for k, (pair, _) in zip(keys, rows) if pair == i)
        met[kind] = met.get(kind, 0) + bool(a & b)
        all_[kind] = all_.get(kind, 0) + 1
    assert len(all_) == 5 and min(all_.values()) >= 50, all_
    assert all(met[k] >= 0.95 * all_[k] for k in all_), (met, all_)


@pytest.mark.parametrize("count", [5, 10, 20, 50, 100, 200])
def test_bands_meet_pairs_at_the_threshold(count):
    """Recall of the bands for sets of ``count`` shingles at the least similarity that links."""
    rng = np.random.default_rng(count)
    keep = int(np.ceil(2 * 0.8 * count / 1.8))
    met = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 2 * count - keep, dtype=np.uint64)
        a, b = (set(lines.band_keys(v, np.array([len(v)]))[0][0].tolist()) for v in (x[:count], x[count - keep:]))
        met += bool(a & b)
    assert met >= 980, met


def test_shingles_are_characters(spark):
    rng = random.Random(3)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    texts = ["plain ascii, long enough", "naïve café, long enough", "ascii then é", "😀 emoji 👩\u200d👩 end of it", "日本語テキスト中文", han,
             "long enough, says plain ascii, long enough", "ten chars.", "nine char", "nine char ", "a", "é"]
    hashes, counts = lines.shingles(texts)
    want = [w for t in texts for w in ([t[i:i + 10] for i in range(len(t) - 9)] or [t])]
    assert list(counts) == [max(len(t) - 9, 1) for t in texts]
    # equal exactly where the windows are
    assert len(set(want)) == len(set(hashes.tolist())) == len(set(zip(want, hashes.tolist(), strict=True)))
    # alone or among others, a text has the same hashes
    assert all(np.array_equal(lines.shingles([t])[0], part)
               for t, part in zip(texts, np.split(hashes, np.cumsum(counts)[:-1])))
    # one character of 60 changed: 0.67 in characters (0.87 in bytes), so both stay
    docs = spark.createDataFrame([(1, han), (2, han[:30] + "一" + han[31:])], "doc_id bigint, text string")
    assert [r.n_kept for r in lines.dedup_lines(docs).collect()] == [1, 1]


def test_signatures_and_sets_are_native_and_those_of_numpy(spark):
    """No Python runs in any step of the line dedup, two lines share a band key exactly where
    ``signatures`` says so, and the sets hold the hashes of ``shingles``."""
    rng = random.Random(19)
    base = ["".join(rng.choices("abcdé日😀 xyz", k=rng.randint(1, 120))) for _ in range(60)]
    other = [t[:k] + "Q" + t[k + 1:] for t in base for k in [rng.randrange(len(t))]] + [t + "z" for t in base]
    texts = list(dict.fromkeys(base + other))
    frame = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "lid bigint, n bigint, line string")
    signed = lines.signed(frame)
    sets = frame.select("lid", lines.shingle_set("line").alias("hashes"))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a bigint, b bigint")
    for step in (signed, lines.similarities(pairs, frame, lines.SHINGLE)):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan, plan
    got = {r.lid: set(r["keys"]) for r in signed.collect()}
    want = [set(k) for k in lines.signatures(texts)[0].tolist()]
    met = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] & want[j]]
    assert len(met) > 20
    assert met == [(i, j) for i in range(len(texts)) for j in range(i) if got[i] & got[j]]
    hashes, counts = lines.shingles(texts)
    held = {r.lid: r.hashes for r in sets.collect()}
    for i, part in enumerate(np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])):
        assert len(held[i]) == len(set(held[i])) and set(held[i]) == set(part.tolist())


def test_white_space_lines_stay(spark):
    text = "one line of words here\r\n\r\n\t\n\u3000\n \x0b \nend of document {}, quite unlike\r"
    docs = [(i, text.format("".join(random.Random(i).choices("abcdefgh", k=60)))) for i in range(3)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: t if i == 0 else t.split("\n", 1)[1] for i, t in docs}


def test_line_query(spark):
    docs = [(r.doc_id, r.text) for r in sample_docs(spark).collect()]
    kept, _, _ = brute_lines(docs)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (d, k) in kept) for d, t in docs}
    assert {r.doc_id: r.text for r in op2_line_dedup(spark, DATA).collect()} == want


def test_line_edges(spark):
    docs = edge_docs(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_kept"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text is None and by[0][0].n_lines == 0
    assert by[1][0].text == "" and by[3][0].text == "\n\n \n"
    # row 5 comes twice with one text (one document), row 6 holds the same line later
    assert [r.text for r in by[5]] == ["A plain line of text, nothing more."] * 2 and by[6][0].text == ""
    assert by[15][0].n_kept > 0 and by[16][0].n_kept == 0
    assert lines.dedup_lines(empty_docs(spark)).count() == 0


def test_lines_are_cut_and_grouped_without_python(spark):
    plan = lines.dedup_lines(sample_docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- embeddings --------------------------------------------------------------

def brute_cosine(rows, threshold):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((good[a][0], good[b][0]))
    return links


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(os.path.join(DATA, "embeddings.parquet")).collect()]
    links = brute_cosine(rows, 0.9)
    comp, n = roots([i for i, _ in rows], links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op3_embedding_dedup(spark, DATA).collect()}
    assert got == {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def test_embedding_edges_and_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + 0.25 * rng.standard_normal(16)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[7][1]) for i in range(5)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, []),
             (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [-0.0] * 16),
             (409, [x * 1e200 for x in rows[7][1]]), (410, [x * 1e-200 for x in rows[7][1]])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, kept int")
    scaled = [(i, [x / 1e200 for x in v] if i == 409 else [x * 1e200 for x in v] if i == 410 else v) for i, v in rows]
    links = brute_cosine(scaled, 0.9)
    comp, n = roots([i for i, _ in rows], links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(docs, 0.9, block=50).collect()}
    assert got == {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}
    assert embed.near_duplicates(docs.filter("false")).count() == 0
    null_id = spark.createDataFrame([(None, rows[7][1]), (1, rows[7][1])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links) for r in embed.near_duplicates(null_id).collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("kind, hashed", [("float", False), ("double", True)])
def test_embedding_slices(spark, monkeypatch, kind, hashed):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((9, 12)).astype(np.float32)
    rows = [(i % 170, (centre[i % 9] + np.float32(0.3) * rng.standard_normal(12).astype(np.float32)).tolist()) for i in range(200)]
    rows = [(i, v[:7] if i % 11 == 0 else v) for i, v in rows] + [(500, rows[1][1]), (501, [0.0] * 11 + [1.0]), (502, [-0.0] * 11 + [1.0])]
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(5)
    if not hashed:           # every class under one hash
        monkeypatch.setattr(embed, "_key", lambda v: F.lit(1).cast("bigint") + F.size(v) * 0)
    one = sorted(map(tuple, embed.near_duplicates(frame, 0.9).collect()))
    # a few classes a slice, tiles smaller than that
    many = sorted(map(tuple, embed.near_duplicates(frame, 0.9, block=7, slice_bytes=2500).collect()))
    assert one == many
    links = brute_cosine([(k, v) for k, (_, v) in enumerate(rows)], 0.9)
    n, twice = {}, {*range(30), 500}     # vectors under one id share their links
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    comp = roots({i for i, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in links])
    assert {(i, c) for i, _, c, _ in many} == set(comp.items())
    assert {(i, k) for i, k, _, _ in many if i not in twice} == {(i, n.get(k, 0)) for k, (i, _) in enumerate(rows) if i not in twice}


def test_vectors_are_not_shuffled_for_their_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, 1, i * 7919, rng.standard_normal(8).tolist()) for i in range(60)],
                                  "rep bigint, n bigint, at bigint, v array<double>")
    plans, plain = [], type(frame).mapInArrow

    def noted(self, *args, **named):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args, **named)
    monkeypatch.setattr(type(frame), "mapInArrow", noted)
    embed.near_links(frame, 0.5, block=10).count()
    assert plans and not any("Exchange" in p or "Generate" in p for p in plans)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(9)
    for dim in (3, 64, 300):
        x = rng.standard_normal((200, dim)) + 0.8
        y = rng.standard_normal((150, dim)) + 0.8
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        cos = x @ y.T
        for threshold in (0.2, 0.5, float(np.median(cos))):
            i, j = embed.possible(embed.quantised(x), embed.quantised(y), threshold)
            assert set(zip(*np.nonzero(cos >= threshold))) <= set(zip(i, j))


# ---- exact search ------------------------------------------------------------

def brute_topk(rows, asks, k):
    out = set()
    for q, c in rows:
        if asks(q):
            near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in rows if i != q)[:k]
            out |= {(q, i, dist, r + 1) for r, (dist, i) in enumerate(near)}
    return out


def test_search_query(spark):
    rows = []
    for r in spark.read.parquet(os.path.join(DATA, "embeddings.parquet")).collect():
        rows.append((r.vec_id, sum(1 << d for d, x in enumerate(r.embedding) if x >= 0)))
    assert {tuple(r) for r in op7_topk(spark, DATA).collect()} == brute_topk(rows, lambda q: q % 20 == 0, 10)


def test_search_edges(spark):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(64) if i % 3 else 12345) for i in range(300)]
    signed = [(i, c - (1 << 64) if c >> 63 else c, 7) for i, c in rows]
    frame = spark.createDataFrame([*signed, (None, 5, 1), (900, None, 1)], "vec_id bigint, code bigint, rank int")
    got = mih.top_k(frame, F.col("vec_id") % 7 == 0, k=5, shard=64, query_block=9).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, lambda q: q % 7 == 0, 5)
    assert mih.top_k(frame.filter("vec_id < 3"), F.lit(True), k=9).count() == 6
    assert mih.top_k(frame.filter("false"), F.lit(True)).count() == 0
    vec = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None]), (4, [1.0, -1.0, 0.0]), (5, [float("nan")] * 64)],
                                "vec_id bigint, e array<double>")
    codes = {r.vec_id: r.code for r in vec.select("vec_id", mih.sign_code(F.col("e")).alias("code")).collect()}
    assert codes[1] is codes[2] is codes[3] is codes[5] is None and codes[4] & 7 == 5


def test_search_with_repeated_query_rows(spark):
    # the query's 12 rows fill its code; 8 is in no segment's radius 0, 900 to 907 are met there but further away
    rows = [(0, 0)] * 12 + [(5, 0)] * 3 + [(8, 0x0001000100010001)] * 2
    rows += [(900 + i, (0x1FFF << 16) - (i << 16)) for i in range(8)] + [(20, 0), (20, 0), (20, 3)]
    frame = spark.createDataFrame(rows, "vec_id bigint, code bigint")
    for k in (2, 5, 7):
        got = [tuple(r) for r in mih.top_k(frame, F.col("vec_id") == 0, k=k).collect()]
        assert len(got) == k and set(got) == brute_topk(rows, lambda q: q == 0, k)


# ---- fingerprints ------------------------------------------------------------

def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                found.append(word)
            word = ""
        else:
            word += c
    grams = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_simhash(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3]
    return fps, roots(ids, links)


def test_simhash_query(spark):
    fps, comp = brute_simhash([(r.doc_id, r.text) for r in sample_docs(spark).collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}


def test_simhash_edges(spark):
    docs = edge_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    fps, comp = brute_simhash([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, comp[i]) for i, f in fps.items()}
    everything = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(everything) == edge_docs(spark).count()
    assert [r.component_id for r in everything if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_anchors_meet_every_pair(spark, bits):
    rng = random.Random(bits)
    fps = set()
    for _ in range(120):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r.a, r.b) for r in simhash.linked_fingerprints(spark.createDataFrame(signed, "fp bigint"), bits).collect()}
    flat = sorted(x for x, in signed)
    want = {(a, b) for k, b in enumerate(flat) for a in flat[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want and (bits == 0 or want)


def test_replicas_are_not_broadcast(spark):
    # a table far below the broadcast threshold, whose replicas are not counted
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.linked_fingerprints(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
