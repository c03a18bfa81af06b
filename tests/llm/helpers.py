"""Small hand-made tables and brute-force versions."""

import os
import random

DATA = "/root/testdata/sf0.001"
EDGE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, keys string, rank int"


def path(name):
    import public_tokenizers
    return str(public_tokenizers.path(name))


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, special strings,
    characters off the fast paths, and columns with clashing names."""
    long = " ".join(f"word{i} the, of\nand" for i in range(9000))
    texts = [None, "", " ", "\n\n \n", "a", "A plain line of text, nothing more.", "A plain line of text, nothing more.",
             "It's <|endoftext|> here'll and <|startoftext|>!", "naïve café Öl ßtraße ½ ² Ⅷ", "日本語 テキスト 中文",
             "é combining   nbsp sep", "tabs\t\tand  double  blanks \n next  ", "ΑΣ ΌΣΟΣ İstanbul",
             "12345 678 9,000.00 %%% *** ###", "x" * 3000, long, long, "😀 emoji 👩‍👩‍👧 end", "\x1c\x1d control \x85 chars",
             "don't DON'T we'Re 'S ''' 's", " leading", "trailing ", "\r\nwindows\r\nlines"]
    rows = [(i, t, "en", "src0", None, "x", "y", 1) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id", None, None, None, None, None, None))
    rows.append((5, "A plain line of text, nothing more.", "en", "src0", 3, "x", "y", 2))
    rows.append((4, "another text under a used id", "en", "src0", 3, "x", "y", 2))
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def sample_docs(spark, n=10**9):
    return spark.read.parquet(os.path.join(DATA, "documents.parquet")).limit(n)


def empty_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def roots(nodes, links):
    """Smallest node reachable, by plain union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(rng: random.Random, n, size=(2, 9), letters="abcdefghijklmnopqrstuvwxyz"):
    return ["".join(rng.choices(letters, k=rng.randint(*size))) for _ in range(n)]
