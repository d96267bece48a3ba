"""Ranked lexical search with hashed max-sketches.

Terms are maximal runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased. A document's impact of a term
grows with its frequency and falls with the document's length; a score sums weight times impact over an item's terms,
repeats included. All sums are whole numbers (see ``impacts`` and ``weights``).

1. Items are asked in blocks of about TERMS distinct (item, term) rows, so what is sent to the executors is bounded.
   Whole texts become postings: the document's length and the frequencies of the asked terms. They are written once;
   document frequencies, lengths and counts are summed from them over all documents.
2. A task folds the impacts of each document into a sketch: coordinate ``hash(term) % width`` holds their maximum. One
   product of sketches with the items' summed weights bounds the scores of all its documents for all items.
3. For an item, documents are rescored exactly in order of falling bound, until the bound falls below the kth score that
   the task holds. Every task gives out at most k rows an item; Spark merges them in two steps.

Null and empty texts have no terms and are not counted as documents; every row of ``docs`` is a document of its own, also
where doc_id repeats; rows without doc_id are ranked behind equal scores with one. Texts of one item_id, null included,
are one item. Items without known terms, and empty tables, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, over_texts, slices, stage, texts

#: Coordinates of a sketch.
WIDTH = 1024
#: Rows (item, term) of one block of items; 50,000 of them are a few MB for an executor.
TERMS = 50_000
#: Documents and postings of a sketch block; documents rescored at once; items bounded at once.
DOCS, POSTINGS, CHUNK, ITEMS = 2048, 1 << 20, 64, 512
#: Byte to byte: A-Z to a-z, what is no part of a term to a space.
FOLD = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term and how often the item holds it."""

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                ids, words = part.column("item_id").to_pylist(), [terms(t) for t in texts(part)]
                rows = [np.repeat(np.arange(len(ids)), [len(w) for w in words]), [t for w in words for t in w]]
                owner = pa.array(ids, pa.int64()).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, pa.array(rows[1], pa.binary())], names=["item_id", "term"])

    found = items.select("item_id", "text").mapInArrow(work, "item_id long, term binary")
    return found.groupBy("item_id", "term").agg(F.count("*").alias("c"))


def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """doc_id, number of terms, places in ``known`` of the asked terms it holds and their frequencies; documents without terms are left out."""
    place = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})

    def work(part: pa.RecordBatch):
        find, n, ids, tf = place.value.get, [], [], []
        for text in texts(part):
            words = terms(text)
            at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
            own, count = np.unique(at[at >= 0], return_counts=True)
            n.append(len(words))
            ids.append(own.astype(np.uint32).tobytes())
            tf.append(count.astype(np.uint32).tobytes())
        return {"doc_id": part.column("doc_id"), "n": n, "ids": ids, "tf": tf}

    return over_texts(docs.select("doc_id", "text"), work, "doc_id long, n long, ids binary, tf binary").where("n > 0")


def frequencies(found: DataFrame, count: int) -> np.ndarray:
    """Documents that hold each of ``count`` asked terms: sums by task, then by Spark; ``count`` rows reach the driver at most."""

    def run(batches):
        total = np.zeros(count, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                total[np.frombuffer(ids, np.uint32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(count, np.int64)
    for row in found.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """A block of items: ids, their terms' places and weights, and the summed weights by coordinate."""

    def __init__(self, rows: list, place: dict[bytes, int], weight: np.ndarray, coordinate: np.ndarray, width: int):
        by: dict = {}
        for r in rows:
            at = place[bytes(r["term"])]
            by.setdefault(r["item_id"], []).append((at, r["c"] * int(weight[at])))
        self.ids = list(by)
        self.terms = [np.array([a for a, _ in v], np.int64) for v in by.values()]
        self.weights = [np.array([w for _, w in v], np.int64) for v in by.values()]
        self.summed = np.zeros((width, len(by)))
        for q, (at, w) in enumerate(zip(self.terms, self.weights, strict=True)):
            np.add.at(self.summed[:, q], coordinate[at], w)


class Best:
    """The k best (score, doc_id) of each item; a document without id comes after equal scores."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64) for _ in range(count)]
        self.doc = [np.empty(0, np.int64) for _ in range(count)]
        self.bare = [np.empty(0, bool) for _ in range(count)]

    def least(self, q: int) -> int:
        """Bounds below this cannot enter the list."""
        return int(self.score[q][-1]) if len(self.score[q]) >= self.k else 1

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, bare: np.ndarray) -> None:
        score, doc, bare = (np.concatenate(x) for x in ((self.score[q], score), (self.doc[q], doc), (self.bare[q], bare)))
        top = np.lexsort((doc, bare, -score))
        top = top[score[top] > 0][: self.k]
        self.score[q], self.doc[q], self.bare[q] = score[top], doc[top], bare[top]


def rank_block(items: Items, best: Best, coordinate: np.ndarray, docs: np.ndarray, bare: np.ndarray, m: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tf: np.ndarray) -> int:
    """Sketch a block of documents, bound all items, rescore in order of falling bound; returns the number of rescored documents."""
    width, of = len(items.summed), np.repeat(np.arange(len(docs)), sizes)
    impact = impacts(tf, m[of])
    sketch = np.zeros(len(docs) * width)
    np.maximum.at(sketch, of * width + coordinate[ids], impact.astype(np.float64))
    sketch, start, seen = sketch.reshape(len(docs), width), np.cumsum(sizes) - sizes, 0
    dense = np.zeros(len(coordinate), np.int64)
    for first in range(0, len(items.ids), ITEMS):
        bounds = sketch @ items.summed[:, first : first + ITEMS]  # sums of whole numbers below 2**53: exact
        for q in range(first, first + bounds.shape[1]):
            bound = bounds[:, q - first]
            left = np.flatnonzero(bound >= best.least(q))
            left = left[np.argsort(-bound[left], kind="stable")]
            dense[items.terms[q]] = items.weights[q]
            for s in range(0, len(left), CHUNK):
                pick = left[s : s + CHUNK]
                if bound[pick[0]] < best.least(q):
                    break
                seen += len(pick)
                n = sizes[pick]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(start[pick] - (ends - n), n)
                best.add(q, np.add.reduceat(dense[ids[at]] * impact[at], ends - n), docs[pick], bare[pick])
            dense[items.terms[q]] = 0
    return seen


def _rank(found: DataFrame, rows: list, known: list[bytes], k: int, width: int) -> DataFrame:
    """Best k documents of each item and task."""
    n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return found.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    coordinate = np.arange(len(known)) * 0x9E3779B1 % (1 << 32) * width >> 32
    items = Items(rows, {t: i for i, t in enumerate(known)}, weights(frequencies(found, len(known)), n_docs), coordinate, width)
    shared = found.sparkSession.sparkContext.broadcast((items, coordinate))

    def run(batches):
        items, coordinate = shared.value
        best, held = Best(len(items.ids), k), []

        def flush():
            docs, bare, m, sizes = (np.array([r[i] for r in held], t) for i, t in enumerate((np.int64, bool, np.int64, np.int64)))
            ids, tf = (np.concatenate([r[i] for r in held]).astype(np.int64) for i in (4, 5))
            rank_block(items, best, coordinate, docs, bare, m, sizes, ids, tf)
            held.clear()

        size = 0
        for batch in batches:
            for doc, n, ids, tf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "tf")), strict=True):
                if not ids:
                    continue
                own = np.frombuffer(ids, np.uint32)
                held.append((doc or 0, doc is None, 75 + 25 * n * n_docs // length, len(own), own, np.frombuffer(tf, np.uint32)))
                size += len(own)
                if len(held) >= DOCS or size >= POSTINGS:
                    flush()
                    size = 0
        if held:
            flush()
        for q, item in enumerate(items.ids):
            if len(best.doc[q]):
                n = len(best.doc[q])
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(best.doc[q], mask=best.bare[q]), pa.array(best.score[q])], names=["item_id", "doc_id", "score"])

    return found.select("doc_id", "n", "ids", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def _order(*keys: str | Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))


def search(docs: DataFrame, items: DataFrame, k: int = 20, width: int = WIDTH, block: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item by falling score, ties by rising doc_id."""
    asked = stage(asked_terms(items), "asked")
    blocks, out = max(1, math.ceil(asked.count() / block)), None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)) == b).collect()
        known = sorted({bytes(r["term"]) for r in rows})
        best = _rank(stage(postings(docs, known), "postings"), rows, known, k, width)
        out = best if out is None else out.union(best)
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = out.withColumn("salt", salt).withColumn("rank", _order("item_id", "salt")).where(F.col("rank") <= k)
    return some.withColumn("rank", _order("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
