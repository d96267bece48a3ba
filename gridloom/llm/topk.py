"""Exact top-k by inner product with a vector-approximation file.

Components become integers, floor(scale * x). Rows are packed into blocks of BLOCK vectors as they are read. Every block
holds the cell of each component (its value shifted right by SHIFT bits, one byte where it fits) beside the exact vectors.
For a block of queries, a scan of the cells gives bounds on all inner products; the kth largest lower bound rules most
rows out; of the others, exact vectors are read in order of falling upper bound (the search is for the largest products)
until the kth result is certain.

Query blocks meet row blocks by an equality join on the query block's number, with blocks as rows; the pairs of blocks are
then dealt evenly over tasks. Each task keeps k results a query and row block; they are merged by Spark.

Vectors with components so large that sums of products could leave the whole numbers of doubles are held apart. Their products are bounded by floating-point
products with a margin for rounding, and the exact ones are Python integers. A score beyond 64 bits is returned as the
nearest that fits; a scaled component beyond the range of doubles counts as the largest double.

Vectors that are null or empty or hold null, NaN or infinite components take no part. Only vectors of the same length meet.
Ties go to the smaller vec_id; rows of the query's own vec_id are no candidates; a vec_id repeated with equal vectors counts
once, one with several vectors is searched with all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 4096
QUERIES = 1024
SHIFT = 4
#: Products of vectors whose squared components, times their length, stay below this are whole numbers that doubles hold.
LARGE = 2.0**52
BLOCK_SCHEMA = "q long, n int, dim int, large boolean, ids binary, cells binary, exact binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v``, the vector in doubles, of all vectors that take part."""
    finite = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) <> double('inf'))"
    return vectors.where(finite).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def pack(rows: DataFrame, scale: int, size: int | None = BLOCK) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, kind and ``q``, as whole numbers, from the rows of each partition as they come."""

    def run(batches):
        held: dict[tuple, tuple[list, list]] = {}
        for batch in batches:
            v = batch.column("v")
            at = v.offsets.to_numpy().astype(np.int64) - (v.offsets[0].as_py() if batch.num_rows else 0)
            ids, q, lengths = batch.column("vec_id").to_numpy(), batch.column("q").to_numpy(), np.diff(at)
            with np.errstate(over="ignore"):
                flat = np.nan_to_num(np.floor(v.flatten().to_numpy().astype(float) * scale))
                large = np.maximum.reduceat(np.abs(flat), at[:-1]) ** 2 * lengths >= LARGE if len(lengths) else np.zeros(0, bool)
            for key in {*zip(q.tolist(), lengths.tolist(), large.tolist(), strict=True)}:
                pick = np.flatnonzero((q == key[0]) & (lengths == key[1]) & (large == key[2]))
                own = held.setdefault(key, ([], []))
                own[0].append(ids[pick])
                own[1].append(flat[at[pick][:, None] + np.arange(key[1])])
                if size and sum(map(len, own[0])) >= size:
                    yield from _blocks(*key, *held.pop(key), size)
        for key, own in held.items():
            yield from _blocks(*key, *own, size)

    return rows.select("q", "vec_id", "v").mapInArrow(run, BLOCK_SCHEMA)


def _blocks(q: int, dim: int, large: bool, ids: list, parts: list, size: int | None):
    ids, exact = np.concatenate(ids).astype(np.int64), np.concatenate(parts) + 0.0
    first = sorted({(i, x.tobytes()): r for r, (i, x) in reversed([*enumerate(zip(ids.tolist(), exact, strict=True))])}.values())
    ids, exact = ids[first], exact[first]
    for s in range(0, len(ids), size or len(ids)):
        own = exact[s : s + (size or len(ids))]
        if not large:
            own = own.astype(np.int32)
        cells = own[:0] if large else own >> SHIFT
        narrow = np.int8 if np.abs(cells).max(initial=0) < 127 else np.int32
        row = [q, len(own), dim, large, ids[s : s + len(own)].tobytes(), cells.astype(narrow).tobytes(), own.tobytes()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)


def _unpack(n, dim, large, ids, exact):
    return np.frombuffer(ids, np.int64), np.frombuffer(exact, np.float64 if large else np.int32).reshape(n, dim)


def search_block(queries, q_ids, ids, cells, exact, k: int):
    """Row numbers and products of each query's k best rows of one block; and how many exact vectors were read."""
    q = queries.astype(np.float64)
    # A component lies in [cell * 2**SHIFT, cell * 2**SHIFT + 2**SHIFT - 1]; all sums are whole numbers below 2**53.
    base = q @ (cells.astype(np.float64) * (1 << SHIFT)).T
    slack = (1 << SHIFT) - 1
    low = base + slack * np.minimum(q, 0).sum(1)[:, None]
    high = base + slack * np.maximum(q, 0).sum(1)[:, None]
    return _search(low, high, lambda i, rows: exact[rows].astype(np.int64) @ queries[i].astype(np.int64), q_ids, ids, k)


def search_large(queries, q_ids, ids, exact, k: int):
    """The same where either side has large components; products are Python integers."""
    q, x = queries.astype(np.float64), exact.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        base = q @ x.T
        margin = (np.abs(q) @ np.abs(x).T) * (q.shape[1] + 4) * 2.0**-51 + 1
        low, high = base - margin, base + margin
    open_ = ~(np.isfinite(base) & np.isfinite(margin))
    low[open_], high[open_] = -np.inf, np.inf

    def products(i, rows):
        own = [int(c) for c in q[i].tolist()]
        return np.array([sum(a * int(b) for a, b in zip(own, r, strict=True)) for r in x[rows].tolist()], object)

    return _search(low, high, products, q_ids, ids, k)


def _search(low, high, products_of, q_ids, ids, k: int):
    own = q_ids[:, None] == ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    keep = min(k, len(ids))
    sure = np.partition(low, len(ids) - keep, axis=1)[:, len(ids) - keep]
    read, out = 0, []
    for i in range(len(q_ids)):
        left = np.flatnonzero((high[i] >= sure[i]) & ~own[i])
        left = left[np.lexsort((ids[left], -high[i][left]))]
        rows, products = np.empty(0, np.int64), np.empty(0, np.int64)
        for s in range(0, len(left), 64):
            more = left[s : s + 64]
            if len(rows) >= k and products[k - 1] > high[i][more[0]]:
                break
            read += len(more)
            rows = np.concatenate([rows, more])
            products = np.concatenate([products, products_of(i, more)])
            best = sorted(range(len(rows)), key=lambda j: (-products[j], ids[rows[j]]))[:k] if products.dtype == object else np.lexsort((ids[rows], -products))[:k]
            rows, products = rows[best], products[best]
        out.append((rows, products))
    return out, read


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows, over all rows."""
    whole = usable(vectors)
    queries = whole.where(is_query)
    n_blocks = max(1, math.ceil(queries.count() / QUERIES))
    numbered = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).repartition(n_blocks, "q")
    q = pack(numbered, scale, None).select("q", *[F.col(c).alias(f"q_{c}") for c in ("n", "dim", "large", "ids", "exact")])
    rows = pack(whole.withColumn("q", F.lit(0).cast("long")), scale).drop("q")
    met = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))).join(q, "q").where("dim = q_dim").drop("q", "q_dim")
    # One task a pair of blocks, about: by their work, not by their bytes.
    dealt = met.repartition(min(20_000, n_blocks * max(1, math.ceil(whole.count() / BLOCK)) + 7))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                q_ids, q_exact = _unpack(x["q_n"], x["dim"], x["q_large"], x["q_ids"], x["q_exact"])
                ids, exact = _unpack(x["n"], x["dim"], x["large"], x["ids"], x["exact"])
                if x["large"] or x["q_large"]:
                    found, _ = search_large(q_exact, q_ids, ids, exact, k)
                else:
                    cells = np.frombuffer(x["cells"], np.int8 if len(x["cells"]) == exact.size else np.int32).reshape(exact.shape)
                    found, _ = search_block(q_exact, q_ids, ids, cells, exact, k)
                sizes = [len(f[0]) for f in found]
                scores = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for f in found for s in f[1]]
                arrays = [np.repeat(q_ids, sizes), ids[np.concatenate([f[0] for f in found]).astype(np.int64)], np.array(scores, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
