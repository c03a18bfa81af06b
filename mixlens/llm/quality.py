"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A document's terms are the trigrams of its character classes (letters by
case, digits, blanks, line ends, each ASCII sign) over the whole text, the
word bigrams' repetition and the compressibility of the text as graded terms.
From a bounded sample of labelled documents (``SAMPLE`` rows, taken by hash
rank of the id, per label value) term weights (log frequency x inverse
document frequency) and a singular value decomposition give the latent space.
The labelled vectors (``SAMPLE`` x ``RANK`` numbers, a fixed bound) are
broadcast; blocks of documents meet all of them in one exact cosine product,
and the ``NEIGHBOURS`` nearest vote with weights that grow with similarity.
Votes are weighted against the sampling rate of their label.

Defined results: NULL and empty texts are documents without terms and score
the labelled share of label 1; a NULL id is scored but never learned from (and
is not held out); repeated label rows of one document count once (the larger
label), repeated document rows are scored each and learned from once (the
least text); labels other than 0 and 1, and NULL, are not learned from; other
columns are ignored; without any usable label every score is 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2048              # labelled rows learned from per label value, at most
TERMS = 4096               # terms kept: the most widespread in the sample
RANK = 64                  # latent dimensions
NEIGHBOURS = 15
SHARPNESS = 8.0            # a neighbour's vote weighs similarity to this power
BLOCK = 1024               # documents of one cosine product
N_CLASSES = 40
GRADES = 16                # steps of each graded term


def byte_classes():
    """The class of each byte: letters by case, digits, blanks, line ends, every
    ASCII sign of its own, bytes beyond ASCII as small letters."""
    import numpy as np
    table = np.zeros(256, dtype=np.int64)
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        if c >= 128 or 97 <= c <= 122:
            table[c] = 0
        elif 65 <= c <= 90:
            table[c] = 1
        elif 48 <= c <= 57:
            table[c] = 2
        elif c in (10, 13):
            table[c] = 3
        elif c <= 32 or c == 127:
            table[c] = 4
        else:
            table[c] = 5 + signs.index(c)
    return table


def term_counts(text: str | None, classes):
    """(terms, counts) of one whole text; terms are numbers."""
    import numpy as np
    raw = (text or "").encode()
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.float64)
    c = classes[np.frombuffer(raw, dtype=np.uint8)]
    # runs of one class count once: words become their shapes
    c = c[np.append(True, c[1:] != c[:-1])] if len(c) > 1 else c
    n = N_CLASSES
    tri = (c[:-2] * n + c[1:-1]) * n + c[2:] if len(c) > 2 else c[:1] * n * n
    count = np.bincount(tri)
    terms = np.flatnonzero(count)
    value = count[terms] / max(1, len(tri))
    # how well the text compresses, and how often a word follows itself, as graded terms
    packed = len(zlib.compress(raw, 1)) / (len(raw) + 12)
    words = raw.split()
    same = sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0.0
    upper = float((classes[np.frombuffer(raw, dtype=np.uint8)] == 1).mean())
    base = n ** 3
    graded = [base + int(min(GRADES - 1, packed * GRADES)), base + GRADES + int(min(GRADES - 1, same * GRADES)),
              base + 2 * GRADES + int(min(GRADES - 1, upper * GRADES))]
    return np.append(terms, graded), np.append(value, [0.25, 0.25, 0.25])


def _sparse(texts, classes):
    """(row, term, value) arrays of many texts."""
    import numpy as np
    rows, terms, values = [], [], []
    for k, t in enumerate(texts):
        a, b = term_counts(t, classes)
        rows.append(np.full(len(a), k))
        terms.append(a)
        values.append(b)
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(values)


class LatentSpace:
    """Terms, weights and axes learned from sampled documents."""

    def __init__(self, column, idf, axes):
        self.column, self.idf, self.axes = column, idf, axes

    @classmethod
    def learned(cls, rows, terms, values, n_docs: int, n_terms: int = TERMS, rank: int = RANK):
        import numpy as np
        found, place, spread = np.unique(terms, return_inverse=True, return_counts=True)
        keep = np.argsort(-spread, kind="stable")[:n_terms]
        column = np.full(N_CLASSES ** 3 + 3 * GRADES, -1, dtype=np.int64)
        column[found[keep]] = np.arange(len(keep))
        space = cls(column, np.log((1.0 + n_docs) / (1.0 + spread[keep])) + 1.0, None)
        matrix = space.weighted(rows, terms, values, n_docs)
        # leading right singular vectors by subspace iteration from a fixed start
        start = np.random.default_rng(0).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape)))
        basis = np.linalg.qr(matrix.T @ (matrix @ start))[0]
        for _ in range(6):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        _, power, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
        axes = (basis @ turn.T)[:, :rank][:, power[:rank] > 1e-6]
        space.axes = np.ascontiguousarray(axes.astype(np.float32))
        return space

    def weighted(self, rows, terms, values, n_docs: int):
        """Documents x terms, rows of length 1 (or 0)."""
        import numpy as np
        at = self.column[terms]
        ok = at >= 0
        out = np.zeros((n_docs, len(self.idf)), dtype=np.float32)
        out[rows[ok], at[ok]] = np.log1p(values[ok] * 100.0) * self.idf[at[ok]]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    def vectors(self, rows, terms, values, n_docs: int):
        """Latent unit vectors (zero rows where a document has no known term)."""
        import numpy as np
        v = self.weighted(rows, terms, values, n_docs) @ self.axes
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(size == 0, 1, size)


def vote(vectors, known, label, weight, prior: float, neighbours: int = NEIGHBOURS, block: int = BLOCK):
    """Scores in [0, 1]: the weighted share of label 1 among the nearest labelled
    vectors, by exact cosine products of one block of documents at a time.
    Ties at the last place go to the smaller position."""
    import numpy as np
    out = np.full(len(vectors), prior, dtype=np.float64)
    k = min(neighbours, len(known))
    for at in range(0, len(vectors), block):
        part = vectors[at:at + block]
        cosine = part @ known.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(known) else \
            np.broadcast_to(np.arange(len(known)), cosine.shape)
        similar = np.clip(np.take_along_axis(cosine, near, axis=1), 0.0, 1.0).astype(np.float64)
        pull = similar ** SHARPNESS * weight[near]
        total = pull.sum(axis=1)
        share = np.where(total > 1e-12, (pull * label[near]).sum(axis=1) / np.where(total > 1e-12, total, 1), prior)
        empty = ~part.any(axis=1)
        out[at:at + block] = np.clip(np.where(empty, prior, share), 0.0, 1.0)
    return out


def held_out(id_col: Column) -> Column:
    """Whether crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text, total): per label value the ``sample`` labelled documents of
    smallest hash rank, none held out; ``total``: labelled rows of that value."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")))
    known = known.withColumn("rank", F.xxhash64("_id"))
    picked = [known.filter(F.col("label") == v).orderBy("rank", "_id").limit(sample) for v in (0, 1)]
    totals = known.groupBy("label").agg(F.count("*").alias("total"))
    few = picked[0].unionAll(picked[1]).join(F.broadcast(totals), "label")      # at most 2 x sample rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # documents that repeat an id are one sampled row, the least of their texts
    return (texts.join(F.broadcast(few), "_id").groupBy("_id", "label", "total").agg(F.min("text").alias("text"))
            .select("_id", "label", "total", "text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality"):
    """The model from at most 2 x ``sample`` labelled documents: their term
    counts, made in tasks, come to the driver; texts do not."""
    import numpy as np
    classes = byte_classes()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            raw = []
            for cell in batch.column(3):
                a, b = term_counts(cell.as_py(), classes)
                raw.append(a.astype("<i8").tobytes() + b.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary())],
                names=["id", "label", "total", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = (sampled(docs, labels, sample, id_col, text_col, label_col)
           .mapInArrow(run, f"id {kind}, label int, total bigint, terms binary").collect())
    got = sorted(got, key=lambda r: (r["id"], bytes(r["terms"])))
    if not got:
        return None
    rows, terms, values = [], [], []
    for k, r in enumerate(got):
        half = len(r["terms"]) // 2
        terms.append(np.frombuffer(r["terms"][:half], "<i8"))
        values.append(np.frombuffer(r["terms"][half:], "<f8"))
        rows.append(np.full(len(terms[-1]), k))
    sparse = np.concatenate(rows), np.concatenate(terms), np.concatenate(values)
    space = LatentSpace.learned(*sparse, len(got))
    label = np.array([r["label"] for r in got], dtype=np.float64)
    totals = {r["label"]: r["total"] for r in got}
    seen = {v: max(1, int((label == v).sum())) for v in totals}
    # a label sampled at a lower rate speaks for more documents
    weight = np.array([totals[r["label"]] / seen[r["label"]] for r in got], dtype=np.float64)
    prior = totals.get(1, 0) / sum(totals.values())
    return space, space.vectors(*sparse, len(got)), label, weight, prior


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``score`` column, which replaces one of that name."""
    names = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*names).withColumn("score", F.lit(0.5))
    space, *known = model
    # plain arrays of a few MB, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast([space.column, space.idf, space.axes, *known])

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        column, idf, axes, known, label, weight, prior = shared.value
        space = LatentSpace(column, idf, axes)
        classes = byte_classes()
        for texts in parts:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                block = texts.iloc[at:at + BLOCK]
                sparse = _sparse(block, classes)
                out[at:at + BLOCK] = vote(space.vectors(*sparse, len(block)), known, label, weight, prior)
            yield pd.Series(out)

    return docs.select(*names, scores(text_col).alias("score"))
