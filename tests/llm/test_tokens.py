"""Operators 4, 5, 9, 10: ids against the tokenizer libraries, row by row."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mixlens.llm import bpe, counts, packing, repair, wordtable
from mixlens.llm.queries import op4_packing, op5_token_counts, op9_repair, op10_bpe
from tests.llm.helpers import DATA, edge_docs, empty_docs, path, sample_docs

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")


def library(file):
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def both(spark):
    return edge_docs(spark).select("doc_id", "text").unionAll(sample_docs(spark).select("doc_id", "text"))


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_fast_ids_are_the_librarys(spark, file):
    vocab, ids = bpe.Vocabulary(file), library(file)
    assert vocab.plain
    for row in both(spark).collect():
        assert vocab.ids(row.text or "").tolist() == ids(row.text)
    rng = random.Random(3)
    alphabet = "ab th's'll  \n\t.,!<|>é½²ßİıſ0123日é '"
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert vocab.ids(text).tolist() == ids(text), repr(text)


def check_packing(rows, texts, capacity, ids_of, end_id):
    """Every id of every document is in one piece, and sequences are gapless."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids = np.array([*ids_of(text), *([] if end_id is None else [end_id])], dtype="<u4")
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == capacity for p in parts[1:]) and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.start == sum(q.length for q in parts[:p.piece])
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    return len(by_seq)


def test_packing_query(spark):
    rows = op4_packing(spark, DATA).collect()
    texts = [(r.doc_id, r.text) for r in sample_docs(spark).collect()]
    used = check_packing(rows, texts, 1024, library(BYTE), 2)
    total = sum(r.length for r in rows)
    assert used <= -(-total // 1024) + 2          # within two sequences of the bound


def test_packing_edges(spark):
    docs = edge_docs(spark)
    out = packing.packed_documents(docs, BYTE, capacity=64, end_id=2)
    rows = out.collect()
    unique = {}
    for r in docs.collect():
        unique.setdefault(r.doc_id, []).append(r.text)
    ids = library(BYTE)
    single = [(k, v[0]) for k, v in unique.items() if len(v) == 1]
    check_packing([r for r in rows], single, 64, ids, 2)
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) + 1 for r in docs.collect())
    assert packing.packed_documents(empty_docs(spark), BYTE).count() == 0


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        reach = {0}
        for size, n in left.items():
            reach = {r + size * k for r in reach for k in range(n + 1) if r + size * k <= room}
        got = packing.fullest(room, left)
        assert sum(got) == max(reach)
        assert all(got.count(s) <= left[s] for s in set(got))


def test_plan_uses_every_rank_once():
    rng = random.Random(2)
    sizes = {s: rng.randint(1, 500) for s in rng.sample(range(1, 129), 60)}
    seen = {s: 0 for s in sizes}
    for size, first, end, copies, _, _ in packing.bin_plan(sizes, 128):
        assert first == seen[size] and (end - first) % copies == 0
        seen[size] = end
    assert seen == sizes


def test_counts_query(spark):
    ids = library(WORD)
    got = {r.doc_id: r for r in op5_token_counts(spark, DATA).collect()}
    rows = sample_docs(spark).collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(ids(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (
            n, len(r.text.encode()), n > 2048)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_counts_edges_and_prefixes(spark, file):
    ids, vocab = library(file), bpe.Vocabulary(file)
    docs = edge_docs(spark)
    out = counts.prefix_counts(docs, file).collect()
    assert len(out) == docs.count()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_bytes) for r in out) == sorted(
        (r.doc_id or -1, len(ids(r.text)), len((r.text or "").encode())) for r in docs.collect())
    assert counts.prefix_counts(empty_docs(spark), file).count() == 0
    for text in [r.text for r in docs.collect() if r.text and len(r.text) < 200]:
        ends, tokens = counts.text_prefixes(vocab, text)
        for e, c in zip(ends, tokens):
            if vocab.suffix or vocab.regular(text):
                assert len(ids(text[:e])) == c
        if vocab.regular(text) and not text.endswith(" ") and "  " not in text:
            for cut in range(len(text) + 1):
                if vocab.suffix or not text[:cut].endswith((" ", "\n")):
                    assert counts.count_at(vocab, text, ends, tokens, cut) == len(ids(text[:cut])), (text, cut)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_prefix_dynamic_programming(file):
    ids, vocab = library(file), bpe.Vocabulary(file)
    rng = random.Random(5)
    for _ in range(150):
        word = "".join(rng.choices("aeiothnrsélü", k=rng.randint(1, 14)))
        assert counts.word_prefix_counts(vocab, word) == [len(ids(word[:k])) for k in range(len(word) + 1)]


def test_truncate(spark):
    ids, text = library(WORD), "antidisestablishment of the throngs"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    rows = counts.prefix_counts(docs, WORD).join(docs, "doc_id")
    for budget in (0, 1, 3, 5, 99):
        got = {r.doc_id: r.truncated for r in counts.truncate(rows, WORD, budget).collect()}
        assert len(ids(got[1])) <= budget and got[2] is None
        if budget == 99:
            assert got[1] == text


def starts(rows, file, end_id=2):
    ids, at, out = library(file), 0, []
    for doc_id, text in rows:
        raw = np.array([*ids(text), end_id], dtype="<u4")
        out.append((doc_id, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    return out


def test_repair_query(spark):
    got = sorted(tuple(r) for r in op9_repair(spark, DATA).collect())
    assert got == starts(sorted((r.doc_id, r.text) for r in sample_docs(spark).collect()), WORD)


def test_repair_edges(spark):
    docs = edge_docs(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    files = repair.written(docs, WORD, shard_chars=4000)
    got = sorted((tuple(r) for r in repair.read_documents(files).collect()), key=lambda x: x[1])
    assert got == starts(rows, WORD)
    empty = repair.written(empty_docs(spark), WORD)
    assert empty.count() == 0 and repair.read_documents(empty).count() == 0


def test_repair_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    for trial in range(30):
        words = [rng.integers(0, 6, rng.integers(1, 5)) for _ in range(int(rng.integers(1, 12)))]
        lengths = np.array([len(w) for w in words])
        pool = np.concatenate(words).astype(np.uint32)
        stream = rng.integers(0, len(words), int(rng.integers(1, 400)))
        ends = np.unique(np.append(rng.integers(0, len(stream), 5), len(stream) - 1))
        rules, seq, doc_ends = repair.grammar(pool, np.cumsum(lengths) - lengths, lengths, stream, ends)
        rec = repair.Record(repair.write_record(list(range(len(ends))), rules, seq, doc_ends))
        plain = np.concatenate([words[w] for w in stream])
        assert rec.expand(rec.sequence).tolist() == plain.tolist()
        edge = np.append(0, np.cumsum(lengths[stream])[ends])
        for k in range(len(ends)):
            assert rec.document(k).tolist() == plain[edge[k]:edge[k + 1]].tolist()
        a = int(rng.integers(0, len(plain)))
        b = int(rng.integers(a, len(plain) + 1))
        assert rec.ids(a, b).tolist() == plain[a:b].tolist()
        assert rec.lengths(rec.sequence).sum() == len(plain)
    assert repair.grammar(np.zeros(1, np.uint32), np.array([0]), np.array([1]), np.zeros(64, np.int64),
                          np.array([63]))[0].size > 0          # a run of one id compresses


def digests(text, ids, back):
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def test_word_table_query(spark):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe(spark, DATA).collect()}
    rows = sample_docs(spark).collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == digests(r.text, ids, t.decode(ids, skip_special_tokens=False))


def test_word_table_edges(spark):
    t = Tokenizer.from_file(BYTE)
    docs = edge_docs(spark)
    out = wordtable.encode_decode(docs, BYTE, chunk_bytes=5000).collect()
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id if r.doc_id is not None else -1, len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, list(r.ids), r.decoded) for r in out),
                  key=key) == sorted(want, key=key)
    assert wordtable.encode_decode(empty_docs(spark), BYTE).count() == 0


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(9)
    for case in range(12):
        n_ids = [2, 3, 12][case % 3]
        lengths = rng.integers(1, 9, 30)
        pool = rng.integers(0, n_ids, int(lengths.sum())).astype(np.uint32)
        if case % 2:
            pool[: len(pool) // 2] = 1                     # long runs of one id
        stream = rng.integers(0, 30, 500)
        ends = np.unique(np.append(rng.integers(0, 500, 6), 499))
        rules, seq, doc_ends = repair.grammar(pool, np.cumsum(lengths) - lengths, lengths, stream, ends)
        seen = {}
        for a, b in zip(np.append(0, doc_ends), doc_ends):
            last = {}
            for i in range(a, b - 1):                      # occurrences that do not overlap, from the left
                pair = (int(seq[i]), int(seq[i + 1]))
                if last.get(pair) != i - 1:
                    last[pair] = i
                    seen[pair] = seen.get(pair, 0) + 1
        assert len(rules) and max(seen.values(), default=0) < repair.LEAST


def recounted(seq, closed, first):
    """Pair replacement as ``repair`` does it, every round over the whole sequence."""
    rules = []
    while True:
        places, count, last = [], {}, {}
        for i in range(len(seq) - 1):
            pair = (seq[i], seq[i + 1])
            if not closed[i] and last.get(pair) != i - 1:
                last[pair] = i
                places.append(i)
                count[pair] = count.get(pair, 0) + 1
        rank = {i: (count[seq[i], seq[i + 1]], (seq[i], seq[i + 1])) for i in places if count[seq[i], seq[i + 1]] >= repair.LEAST}
        best = [i for i in rank if all(rank[i] > rank.get(j, (0,)) for j in (i - 1, i + 1))]
        used = {}
        for i in best:
            used[seq[i], seq[i + 1]] = used.get((seq[i], seq[i + 1]), 0) + 1
        new = {pair: first + len(rules) + k for k, pair in enumerate(sorted(p for p in used if used[p] >= repair.LEAST))}
        if not new:
            return rules, seq
        best = {i for i in best if (seq[i], seq[i + 1]) in new}
        rules += sorted(new)
        closed = [closed[i + 1] if i in best else closed[i] for i in range(len(seq)) if i - 1 not in best]
        seq = [new[seq[i], seq[i + 1]] if i in best else seq[i] for i in range(len(seq)) if i - 1 not in best]


def test_repair_rounds_equal_full_recounts_and_look_at_few_places(monkeypatch):
    rng = np.random.default_rng(11)
    looked, whole, one = 0, 0, repair._round

    def counting(seq, closed, weight, at, *rest):
        nonlocal looked, whole
        looked, whole = looked + len(at), whole + len(seq)
        return one(seq, closed, weight, at, *rest)
    monkeypatch.setattr(repair, "_round", counting)
    for case in range(40):
        n = int(rng.integers(0, 900))
        seq = np.minimum(rng.zipf(1.3, n), 400) if case % 2 else rng.integers(0, [2, 3, 30][case % 3], n)
        closed = rng.random(n) < [0.0, 0.05][case // 2 % 2]
        closed[-1:] = True
        want_rules, want = recounted(seq.tolist(), closed.tolist(), repair.RULE0)
        got, shut, rules = repair._rounds(seq.astype(np.int64), closed, None, repair.RULE0)
        assert got.tolist() == want
        assert [tuple(p) for part in rules for p in part.tolist()] == want_rules
    assert looked < whole / 2
