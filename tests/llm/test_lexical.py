"""Ranked lexical search against a plain version over all documents."""

import math
import random
import re

from mixlens.llm import lexical
from tests.llm.helpers import DATA, edge_docs, empty_docs, sample_docs, words

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=10):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for word in set(t):
            df[word] = df.get(word, 0) + 1
    w = {word: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for word, d in df.items()}
    out = []
    for item, text in items:
        asked, found = split(text), []
        for doc, t in held:
            m = 100 - 75 + (75 * len(t) * n) // total
            score = sum(w[a] * (1000000000 * t.count(a) // (1000 * t.count(a) + 8 * m)) for a in asked if a in t)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_the_contracts():
    text = "It's A-B_c9 É ÀÉ naïve\x7f日本 x\x00y [z] {q} @m `t` 9:30 n\u0085b"
    assert [t.decode() for t in lexical.terms(text.encode())] == split(text)
    assert lexical.terms(None) == [] == lexical.terms(b"")


def test_given_tables(spark):
    docs = sample_docs(spark)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()],
                 [(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    assert rows_of(lexical.top_documents(docs, items)) == want


def test_copies_ties_and_many_groups(spark):
    rng = random.Random(3)
    pool = words(rng, 60)
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(120)]
    # classes of copies (also in another word order: the same bag), repeated ids, NULL ids
    rows = [(i, texts[i % 120] if i % 3 else " ".join(reversed(texts[i % 120].split()))) for i in range(500)]
    rows += [(7, texts[1]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (900, None), (901, "...")]
    items = [(i, " ".join(rng.choices(pool, k=8))) for i in range(25)] + [(3, texts[5]), (None, texts[6]), (70, None), (71, "zzzz")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, item_id string, score int").repartition(6)
    asked = spark.createDataFrame([(*r, 5) for r in items], "item_id bigint, text string, doc_id int")
    want = brute(rows, items)
    assert rows_of(lexical.top_documents(docs, asked)) == want
    assert rows_of(lexical.top_documents(docs, asked, group_bytes=200)) == want
    assert rows_of(lexical.top_documents(docs, asked, k=3)) == brute(rows, items, 3)


def test_edge_and_empty(spark):
    items = spark.createDataFrame([(1, "a plain line of text nothing"), (2, "word7 THE É")], "item_id bigint, text string")
    rows = [(r[0], r[1]) for r in edge_docs(spark).select("doc_id", "text").collect()]
    assert rows_of(lexical.top_documents(edge_docs(spark), items)) == brute(rows, [(1, "a plain line of text nothing"), (2, "word7 THE É")])
    assert lexical.top_documents(empty_docs(spark), items).count() == 0
    assert lexical.top_documents(edge_docs(spark), items.limit(0)).count() == 0
