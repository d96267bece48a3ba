"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of ``width`` words (white-space separated, A-Z lower-cased); with fewer words
the whole sequence is one shingle; without words it is empty and linked with nothing. Two documents are linked if
``100 * |both| >= percent * |either|``.

1. Documents with equal sets become one class, named by its smallest doc_id; only that one is searched for.
2. Signatures are cut into bands; classes that share a band are candidates. Each band's bucket first links its members
   with one hub, so a bucket of any size costs as many pairs as it has members. The hub is the member that shares most
   buckets with others: of many copies of one text, the text itself.
3. Candidates are verified in turns: after each batch of signature values a pair is dropped once the posterior
   probability of a similarity at the threshold (uniform prior) is below ``miss``. Survivors are compared on full sets.
4. Only where a bucket still holds more than one component are its other pairs looked at. Members of its largest component
   need not meet each other, so only the members outside it (strays) are compared, with each other and with all: both kinds
   are dealt into chunks, a cell is a chunk of strays and another chunk, and tasks compare signatures within a cell. From
   buckets of at most DENSE members the pairs of different components that pass all batches leave the task, to be compared
   on full sets; to cells of larger buckets the full sets are sent along, and only links leave the task. Pairs within a
   component cannot change the result.

Null and empty texts have no shingles and form components of their own. Repeated rows of a doc_id stay or go together.
Rows without doc_id are linked with nothing, have a null component and are not kept by it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, give_back, hash64, join_small, over_texts, slices, stage

BANDS, ROWS = 40, 6
BATCH = 24
WIDTH = 5
#: Members of a bucket that meet in one cell, about twice as many where two parts of a bucket meet.
CELL = 256
#: Members up to which a bucket may give out its candidate pairs: half as many a member at most.
DENSE = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    h = np.fromiter(map(hash64, words), np.uint64, len(words))
    if not len(h):
        return h
    factors = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        total += h[i : i + n] * factors[i]
    return np.unique(_mix(total + np.uint64(min(width, len(h)))))


@lru_cache
def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, count), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature(x: np.ndarray, count: int) -> np.ndarray:
    a, b = _hashes(count)
    least = np.full(count, np.uint64((1 << 64) - 1))
    for s in range(0, len(x), 256):
        least = np.minimum(least, (x[s : s + 256, None] * a + b).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set), signature and band keys of whole texts, in one pass."""

    def one(text: bytes):
        x = shingles(text, width)
        if not len(x):
            return 0, None, None, None
        sig = signature(x, bands * rows)
        return len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), sig.tobytes(), band_keys(sig, rows)

    def work(part: pa.RecordBatch):
        found = [one(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
        return {"doc_id": part.column("doc_id"), **dict(zip(("n_shingles", "set_key", "sig", "bands"), zip(*found), strict=True))}

    return over_texts(docs.select("doc_id", "text"), work, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


@lru_cache
def least_matches(count: int, batch: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(values seen, matches needed) per batch: below, P(similarity >= threshold | matches) under a uniform prior is less than ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= percent / 100
    out = []
    for n in range(batch, count + batch, batch):
        n = min(n, count)
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[above].sum() / p.sum() >= miss:
                break
        out.append((n, m))
    return tuple(out)


def prune(pairs: DataFrame, sigs: DataFrame, count: int, percent: int, miss: float) -> DataFrame:
    """Candidate pairs (a, b) that no batch of signature values rules out."""
    needed = stage(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "needed")
    own = stage(join_small(sigs.select("rep", "sig"), needed, "rep", "left_semi"), "signatures")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    steps = least_matches(count, BATCH, percent, miss)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, count) for c in ("sig_a", "sig_b"))
            alive, hits, before = np.arange(n), np.zeros(n, np.int64), 0
            for seen, least in steps:
                hits[alive] += (x[alive, before:seen] == y[alive, before:seen]).sum(1)
                alive, before = alive[hits[alive] >= least], seen
            yield batch.select(["a", "b"]).take(pa.array(alive))
        give_back()

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Exact comparison of two sets of sorted 64-bit values."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def cells(mixed: DataFrame, own: DataFrame, count: int, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of different ``part`` in buckets that no batch of signature values rules out.

    ``mixed`` has bucket, rep, part, n (members), ``strays`` (members outside the largest part) and ``stray``.
    ``own`` has rep, sig and ``x``, the full set as bytes or null. With sets, pairs that are no links are ruled out too.
    """
    # Chunks of strays come first; a member of the largest part meets those only, a stray meets all.
    few, rest = F.ceil(F.col("strays") / CELL), F.ceil((F.col("n") - F.col("strays")) / CELL)
    h = F.xxhash64("rep")
    chunk = F.when(F.col("stray"), F.pmod(h, few)).otherwise(few + F.pmod(h, rest))
    meets = F.when(F.col("stray"), few + rest).otherwise(few)
    dealt = mixed.join(own, "rep").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    dealt = dealt.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "part", "sig", "x")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    steps = least_matches(count, BATCH, percent, miss)

    def compare(key, rows):
        """Pairs of a cell; where two chunks meet, only pairs from one to the other."""
        side, rep, part = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), count)
        for i in range(len(rows) - 1):
            alive = np.arange(i + 1, len(rows))
            alive = alive[(part[alive] != part[i]) & ((side[alive] != side[i]) | (key[1] == key[2]))]
            hits, before = np.zeros(len(alive), np.int64), 0
            for seen, least in steps:
                if not len(alive):
                    break
                hits = hits + (sig[alive, before:seen] == sig[i, before:seen]).sum(1)
                alive, hits, before = alive[hits >= least], hits[hits >= least], seen
            if len(alive) and rows[i][4] is not None:
                alive = alive[[linked(rows[i][4], rows[k][4], percent) for k in alive]]
            if len(alive):
                yield np.minimum(rep[i], rep[alive]), np.maximum(rep[i], rep[alive])

    def run(batches):
        key, held = None, []

        def flush():
            for a, b in compare(key, held) if held else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for part in (p for batch in batches for p in slices(batch, "x")):
            cols = [part.column(c).to_pylist() for c in ("bucket", "i", "j", "chunk", "rep", "part", "sig", "x")]
            for row in zip(*cols, strict=True):
                if row[:3] != key:
                    yield from flush()
                    key, held = row[:3], []
                held.append(row[3:])
        yield from flush()
        give_back()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """rep and ``x``, its full set as sorted 64-bit values, made anew from the texts of the documents ``needed`` (rep)."""
    found = join_small(docs.select(F.col("doc_id").alias("rep"), "text"), stage(needed, "compared"), "rep", "left_semi")

    def work(part: pa.RecordBatch):
        return {"rep": part.column("rep"), "x": [shingles(t or b"", width).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]}

    return stage(over_texts(found, work, "rep long, x binary"), "sets")


def confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full sets x and y are linked; sets of a slice of pairs are opened at once, not of a whole batch."""
    for part in (p for batch in batches for p in slices(batch, "x")):
        keep = [linked(x, y, percent) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def confirm(docs: DataFrame, left: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs linked by their full sets, among candidates."""
    ends = left.select(F.col("a").alias("rep")).union(left.select("b")).distinct()
    sets = full_sets(docs, ends, width)

    both = left.join(sets.select(F.col("rep").alias("a"), "x"), "a").join(sets.select(F.col("rep").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lambda batches: confirmed(batches, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-9) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    prints = stage(fingerprints(docs, width, bands, rows), "fingerprints")
    full = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(full.join(classes, "set_key").where("doc_id = rep").select("rep", "sig", "bands"), "representatives")

    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(banded.join(shared, "bucket"), "members")
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"))).alias("top"))
    starred = members.join(hubs.select("bucket", (-F.col("top.back")).alias("hub")), "bucket").where("rep <> hub")
    first = stage(starred.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "hub-pairs")
    links = stage(confirm(docs, stage(prune(first, reps, bands * rows, percent, miss), "survivors"), width, percent), "links")
    found = components(links)
    placed = members.where("n > 2").join(found, members.rep == found.node, "left").select("bucket", "n", "rep", F.coalesce("root", "rep").alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("own"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("own", "part")).alias("top"), F.sum("own").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    split = split.select("bucket", F.col("top.part").alias("main"), (F.col("all") - F.col("top.own")).alias("strays"))
    mixed = stage(placed.join(split, "bucket").withColumn("stray", F.col("part") != F.col("main")).drop("main"), "mixed")
    sigs = stage(join_small(reps.select("rep", "sig"), stage(mixed.select("rep").distinct(), "needed"), "rep", "left_semi"), "signatures")
    few, many = mixed.where(F.col("n") <= DENSE), mixed.where(F.col("n") > DENSE)
    rest = cells(few, sigs.withColumn("x", F.lit(None).cast("binary")), bands * rows, percent, miss)
    more = confirm(docs, stage(rest.join(first, ["a", "b"], "left_anti"), "cell-pairs"), width, percent)
    sets = full_sets(docs, many.select("rep").distinct(), width)
    more = stage(more.union(cells(many, sigs.join(sets, "rep"), bands * rows, percent, miss)), "more-links")
    if not more.isEmpty():
        found = components(links.union(more))
    rooted = classes.join(found, classes.rep == found.node, "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    placed = prints.join(rooted, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
