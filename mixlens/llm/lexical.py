"""Ranked lexical search with bag deduplication.

For scoring, a document is its bag: how often it holds each term of the items'
vocabulary, and its length norm m.  Documents that agree in both get the same
score for every item, so they form one class: bags are hashed, classes are
verified by comparing the bags themselves, and every class is scored once.
The best k classes of an item (equal scores by the smallest document id) hold
its best k documents; only those classes are expanded, by ascending id.

Items go in groups of at most about ``group_bytes`` of text.  One group's
vocabulary and postings are what is broadcast; each group reads the documents
once and meets all of them, in blocks.  Document counts, lengths and document
frequencies are taken over all documents.

Scores are whole numbers: w = floor(1000 ln((2N + 2) / (2 df + 1))) a term,
m = 25 + (75 n N) div L a document, and the sum over the item's terms, repeats
included, of w ((10^9 tf) div (1000 tf + 8 m)).

Defined results: NULL or empty texts have no terms and are in no answer (nor in
N); repeated document rows are separate documents; equal scores go by ascending
id, a NULL id last; items are rows: a repeated item id gets an answer list for
each of its rows, an item without a known term none; other columns are ignored;
an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import gather, stored

#: bytes that are in no term become blanks, A-Z small letters
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or bytes([b]).isalnum() else 32 for b in range(256))
GROUP_BYTES = 4 << 20        # text of the items whose vocabulary is broadcast at a time
CLASS_BYTES = 16 << 20       # bags of winning classes up to which they are broadcast
CELLS = 1 << 21              # document classes x items scored at a time
SPREAD = 1 << 22             # (class, term, item) meetings at a time


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split() if text else []


def postings(texts: list[bytes | None]) -> SimpleNamespace:
    """Vocabulary of a group of items and, per term, the items that hold it."""
    import numpy as np
    bags = [Counter(terms(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    rows = sorted((vocabulary[t], item, n) for item, bag in enumerate(bags) for t, n in bag.items())
    term, item, times = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), ())))
    return SimpleNamespace(vocabulary=vocabulary, item=item, times=times, items=len(texts),
                           first=np.searchsorted(term, np.arange(len(vocabulary) + 1)),
                           longest=max((sum(b.values()) for b in bags), default=0))


def bags(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, bag): number of terms, and (term number, times) pairs of the
    known ones by term number, as little-endian uint32."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        known = held.value.vocabulary
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                pairs = sorted((known[t], n) for t, n in Counter(words).items() if t in known)
                sizes.append(len(words))
                packed.append(np.array(pairs, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "n", "bag"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(
        count, "doc_id bigint, n bigint, bag binary")


def _frequencies(classes: DataFrame, terms_known: int) -> DataFrame:
    """(term, df): documents that hold each known term, from classes and their sizes."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(terms_known, dtype=np.int64)
        for batch in batches:
            for bag, members in zip(batch.column(0), batch.column(1)):
                total[np.frombuffer(bag.as_py(), "<u4")[::2]] += members.as_py()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    return classes.select("bag", "members").mapInArrow(count, "term int, df bigint").groupBy("term").agg(
        F.sum("df").alias("df"))


class _Best:
    """The k best classes of every item met so far in one task."""

    def __init__(self, items: int, k: int):
        import numpy as np
        self.k, self.items = k, items
        self.bar = np.ones(items, dtype=np.int64)          # score from which a class can still be an answer
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]     # item, score, smallest id, class

    def add(self, scores, smallest, classes):
        import numpy as np
        bar = self.bar
        if len(scores) > self.k:
            bar = np.maximum(bar, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= bar)
        if not len(row):
            return
        new = (item, scores[row, item], smallest[row], classes[row])
        item, score, least, cls = (np.concatenate(pair) for pair in zip(self.rows, new))
        order = np.lexsort((cls, least, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, np.arange(self.items))[item]
        keep = order[place < self.k]
        self.rows = [c[keep] for c in (np.concatenate(pair) for pair in zip(self.rows, new))]
        full = self.rows[0][np.flatnonzero(place[place < self.k] == self.k - 1)]
        self.bar[full] = self.rows[1][np.flatnonzero(place[place < self.k] == self.k - 1)]


def _scored(classes: DataFrame, held, weights, k: int) -> DataFrame:
    """(item, score, least, cls): the k best classes of every item in each task;
    ``least`` is the smallest id in the class, the largest long if all are NULL."""
    def score(batches):
        import numpy as np
        import pyarrow as pa
        post, w = held.value, weights.value
        best = _Best(post.items, k)
        exact = int(w.max(initial=0)) * 10 ** 6 * max(post.longest, 1) < 2 ** 53     # sums are whole numbers in a double
        for batch in batches:
            cls, m, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            packed = [np.frombuffer(b.as_py(), "<u4").astype(np.int64) for b in batch.column(3)]
            size = np.array([len(p) // 2 for p in packed], dtype=np.int64)
            pairs = np.concatenate(packed).reshape(-1, 2) if packed else np.zeros((0, 2), np.int64)
            meets = post.first[pairs[:, 0] + 1] - post.first[pairs[:, 0]]
            ends = np.concatenate(([0], np.cumsum(size)))
            upto = np.concatenate(([0], np.cumsum(meets)))[ends]
            a = 0
            while a < len(cls):
                b = min(int(np.searchsorted(upto, upto[a] + SPREAD, "right")) - 1, a + max(1, CELLS // max(post.items, 1)))
                b = max(b, a + 1)
                term, tf = pairs[ends[a]:ends[b], 0], pairs[ends[a]:ends[b], 1]
                row = np.repeat(np.arange(b - a), size[a:b])
                gain = w[term] * (10 ** 9 * tf // (1000 * tf + 8 * m[a:b][row]))
                n = meets[ends[a]:ends[b]]
                at = gather(np.arange(len(post.item)), post.first[term], n)
                cell = np.repeat(row * post.items, n) + post.item[at]
                value = np.repeat(gain, n) * post.times[at]
                if exact:
                    total = np.bincount(cell, weights=value, minlength=(b - a) * post.items).astype(np.int64)
                else:
                    total = np.zeros((b - a) * post.items, dtype=np.int64)
                    np.add.at(total, cell, value)
                best.add(total.reshape(b - a, post.items), least[a:b], cls[a:b])
                a = b
        item, total, least, cls = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(total), pa.array(least), pa.array(cls)],
                                         names=["item", "score", "least", "cls"])

    nothing = F.lit(2 ** 63 - 1)
    return classes.select("cls", "m", F.coalesce("first_id", nothing).alias("least"), "bag").mapInArrow(
        score, "item int, score bigint, least bigint, cls bigint")


def _group_answers(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(no, rank, doc_id, score) for a group of items (no, text)."""
    import numpy as np
    spark = docs.sparkSession
    post = postings([text for _, text in items])
    held = spark.sparkContext.broadcast(post)
    found = stored(bags(docs, held, id_col, text_col))
    all_docs = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not all_docs[0] or not post.vocabulary:
        return None
    n_docs, n_terms = int(all_docs[0]), int(all_docs[1])
    m = F.expr(f"25 + (cast(75 * n as decimal(20, 0)) * cast({n_docs} as decimal(18, 0))) div {n_terms}")
    # a document without a known term scores 0 everywhere; the hash spreads the classes, the bag verifies them
    known = found.filter(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))
    classes = stored(known.groupBy("h", "m", "bag").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"))
                     .withColumn("cls", F.monotonically_increasing_id()))
    df = np.zeros(len(post.vocabulary), dtype=np.int64)
    for row in _frequencies(classes, len(df)).collect():             # at most one row per term of the group
        df[row["term"]] = row["df"]
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    weights = spark.sparkContext.broadcast(w)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "least", "cls")
    top = stored(_scored(classes, held, weights, k).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k).select("item", "score", "cls"))
    # the k smallest ids of every class that won; a winner's bag finds its documents
    won = stored(top.select("cls").distinct().join(classes.select("cls", "h", "m", "bag"), "cls"))
    size = won.agg(F.sum(F.length("bag") + 32)).first()[0] or 0
    members = known.select("doc_id", "h", "m", "bag").join(F.broadcast(won) if size <= CLASS_BYTES else won, ["h", "m", "bag"])
    by_id = Window.partitionBy("cls").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.select("cls", "doc_id").withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = top.join(members.select("cls", "doc_id"), "cls").withColumn("rank", F.row_number().over(order))
    numbers = spark.createDataFrame([(i, no) for i, (no, _) in enumerate(items)], "item int, no bigint")
    return ranked.filter(F.col("rank") <= k).join(numbers, "item").select("no", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every
    item, those with a score above 0; ids of documents are whole numbers."""
    asked = stored(items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
                   .withColumn("no", F.monotonically_increasing_id()))
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    parts = None
    for g in range(groups):
        mine = asked.filter(F.pmod(F.xxhash64("no"), F.lit(groups)) == g).select("no", F.col("text").cast("binary").alias("text"))
        rows = [(r["no"], None if r["text"] is None else bytes(r["text"])) for r in mine.collect()]     # about group_bytes
        part = _group_answers(docs, rows, k, id_col, text_col) if rows else None
        if part is not None:
            parts = part if parts is None else parts.unionAll(part)
    kind = items.schema[item_col].dataType.simpleString()
    if parts is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return parts.join(asked.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
