"""Line dedup: sorted hash ranges find lines that many documents share; the result is one bitmap per document.

A line's key is the line without white space at its ends, A-Z lower-cased; it travels as a 128-bit hash, never as text.
Hashes are dealt by range with the document as second and the place as third sort key, so a key of a third of all lines
spreads over many tasks. Each task streams its sorted rows and remembers only the current key; a key is known to be
frequent as soon as its ``min_docs``-th document comes. What a task cannot decide alone, the first and last key of its
range, is at most ``min_docs - 1`` documents of rows each plus a count; those meet in a small join.

Null and empty texts are one empty line. Empty keys are never dropped. Repeated rows (doc_id and text equal) are one
document and get the same bitmap; rows of one doc_id with different texts count as one document but have bitmaps of
their own; a row without doc_id is a document named by its text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridloom.llm.common import SPACES, lower_ascii, over_texts, stage, texts

DROP, OPEN, EDGE = 0, 1, 2
FOUND = "kind int, h1 long, h2 long, doc long, tag long, pos int, docs long"
#: Bytes of bitmaps that may be broadcast; measured before each use.
BROADCAST_BYTES = 16 << 20


def named(docs: DataFrame) -> DataFrame:
    """Text, the other columns as ``rest``, and ``doc`` and ``tag``, which name a row's document and its text."""
    text = F.coalesce("text", F.lit(""))
    tag = F.xxhash64(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("rest"), text.alias("text"), tag.alias("tag"), F.coalesce("doc_id", tag).alias("doc"))


def lines(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """One row per line with a key of at least ``min_length`` code points."""
    split = named(docs).select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = split.withColumn("key", lower_ascii(F.btrim("line", F.lit(SPACES)))).where(F.length("key") >= min_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "tag", "pos")


NAMES = ["h1", "h2", "doc", "tag", "pos"]


def _emit(kind: int, cols: list[np.ndarray], docs: int = 0) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, cols), pa.array(np.full(n, docs, np.int64))], names=["kind", *NAMES, "docs"])


class Run:
    """The rows of one key as they come; only those of an undecided key are held, fewer than ``min_docs`` documents."""

    def __init__(self, first: bool, min_docs: int, keep_first: bool):
        self.first, self.min_docs, self.keep_first = first, min_docs, keep_first
        self.start, self.docs, self.last, self.held, self.frequent, self.waiting = None, 0, None, [], False, None

    def feed(self, cols: list[np.ndarray]):
        own = cols[2]
        self.start = self.start or [c[:1] for c in cols]
        self.docs += int((np.diff(own) != 0).sum()) + (self.last is None or own[0] != self.last)
        self.last = own[-1]
        self.held.append(cols)
        if self.docs < self.min_docs:
            return
        if self.keep_first and not self.frequent:
            self.held[0] = [c[1:] for c in self.held[0]]
            self.waiting = self.start if self.first else None  # a range before may hold the true first
        self.frequent = True
        yield from (_emit(DROP, x) for x in self.held if len(x[0]))
        self.held = []

    def close(self, last: bool):
        if self.first or last:
            yield _emit(EDGE, self.start, self.docs)
            yield from (_emit(OPEN, x) for x in [*self.held, *([self.waiting] if self.waiting else [])])


def _whole(cols: list[np.ndarray], min_docs: int, keep_first: bool) -> list[np.ndarray]:
    """Rows to drop among keys that lie whole within a batch."""
    new_key = np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)])
    new_doc = new_key | np.concatenate([[True], np.diff(cols[2]) != 0])
    starts = np.flatnonzero(new_key)
    docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    drop = np.repeat(docs >= min_docs, np.diff([*starts, len(new_key)]))
    if keep_first:
        drop[starts] = False
    return [c[drop] for c in cols]


def _stream(min_docs: int, keep_first: bool):
    def run(batches):
        now, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES]
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            head = int(cuts[0]) if len(cuts) else batch.num_rows
            if now is not None and key != (cols[0][0], cols[1][0]):
                yield from now.close(False)
                now = Run(False, min_docs, keep_first)
            now = now or Run(True, min_docs, keep_first)
            yield from now.feed([c[:head] for c in cols])
            if len(cuts):
                yield from now.close(False)
                tail = int(cuts[-1])
                if tail > head:
                    found = _whole([c[head:tail] for c in cols], min_docs, keep_first)
                    if len(found[0]):
                        yield _emit(DROP, found)
                now = Run(False, min_docs, keep_first)
                yield from now.feed([c[tail:] for c in cols])
            key = (cols[0][-1], cols[1][-1])
        if now is not None:
            yield from now.close(True)

    return run


def repeated(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, tag, pos) of every line to drop: lines of keys in at least ``min_docs`` documents, or all but the first of them."""
    dealt = lines(docs, min_length).repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "tag", "pos")
    found = stage(dealt.mapInArrow(_stream(min_docs, keep_first), FOUND), "lines")
    totals = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min(F.struct("doc", "tag", "pos")).alias("start"))
    late = found.where(F.col("kind") == OPEN).select("h1", "h2", "doc", "tag", "pos").join(totals.where(F.col("total") >= min_docs), ["h1", "h2"])
    if keep_first:
        late = late.where(F.struct("doc", "tag", "pos") != F.col("start"))
    return found.where(F.col("kind") == DROP).select("doc", "tag", "pos").union(late.select("doc", "tag", "pos"))


def bitmaps(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep_first: bool = False) -> DataFrame:
    """doc, tag and ``keep``, a compressed bitmap: bit i is 0 where line i goes; lines past its end stay.

    Documents that keep all lines have no row. A document's places are gathered by document, each once, so bounded by its text
    however often the row is repeated.
    """
    dropped = repeated(docs, min_docs, min_length, keep_first).groupBy("doc", "tag").agg(F.collect_set("pos").alias("places"))

    def run(batches):
        for batch in batches:
            out = []
            for places in batch.column("places"):
                at = places.values.to_numpy()
                bits = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                bits[at] = False
                out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(out, pa.binary())], names=["doc", "tag", "keep"])

    return dropped.mapInArrow(run, "doc long, tag long, keep binary")


def mask(bitmap: bytes | None, n: int) -> np.ndarray:
    """True for the lines that stay, of ``n``."""
    out = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[:n]
        out[: len(bits)] = bits
    return out


def apply(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """text with the kept lines, the other columns as ``rest``, n_lines before, n_dropped and SHA-256 of the kept text.

    Bitmaps are broadcast if their measured bytes allow; otherwise texts and bitmaps are shuffled by document.
    """
    maps = stage(maps, "bitmaps")
    size = maps.agg(F.coalesce(F.sum(F.length("keep") + 40), F.lit(0))).first()[0]
    joined = named(docs).join(F.broadcast(maps) if size <= BROADCAST_BYTES else maps, ["doc", "tag"], "left").select("rest", "text", "keep")

    def work(part: pa.RecordBatch):
        kept, before, gone = [], [], []
        for text, bitmap in zip(texts(part), part.column("keep").to_pylist(), strict=True):
            split = text.split(b"\n")
            stay = mask(bitmap, len(split))
            before.append(len(split))
            gone.append(len(split) - int(stay.sum()))
            kept.append(text if not gone[-1] else b"\n".join(split[i] for i in np.flatnonzero(stay)))
        digests = [hashlib.sha256(t).hexdigest() for t in kept]
        return {"rest": part.column("rest"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": before, "n_dropped": gone, "kept_sha256": digests}

    schema = StructType([joined.schema["rest"], StructField("text", StringType())])
    for name, kind in (("n_lines", LongType()), ("n_dropped", LongType()), ("kept_sha256", StringType())):
        schema = schema.add(name, kind)
    return over_texts(joined, work, schema)
