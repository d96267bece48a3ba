"""Embedding near-dedup: an exact metric range join.

Vectors are linked if their cosine is at least ``cosine``; on the sphere that is an angle of at most ``reach``.

1. Equal vectors become one class, named by its smallest vec_id and weighted by its number of vectors.
2. Pivots come from a bounded sample: middles of dense spots, then single vectors, one for about CELL classes. A class
   within half the reach of a pivot belongs to that pivot's core, any other to the ring of its nearest pivot.
3. Any two members of a core are linked, by the triangle inequality, and are never compared. A vector that is certainly
   linked with a whole core, by its angle to the pivot and the core's radius, is counted without a comparison too.
4. The triangle inequality sets boundary replication: a vector visits a core only if its angle to the pivot is within the
   core's radius plus the reach, and another ring only if its angle to that pivot is within that ring's radius plus the
   reach and the half-space between both pivots is no further than the reach. Of two rings, only one sends visitors.
5. Cells join independently. Cells of more than BLOCK members are cut into blocks; visitors, and members of earlier
   blocks of a ring, are streamed past a block, so a task holds one block. It gives out a weight of links for each vector
   and one edge to the part of the block that the vector is connected with, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and form components of their
own, as do vectors of a length that no other has. Rows without vec_id link with nothing, have no component and are not
kept. A row repeated as a whole counts once but is returned each time; several vectors under one vec_id count each and
fall in one component only through links. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, stage

#: Classes per pivot; members of a block; visitors compared at once.
CELL, BLOCK, VISITORS = 4096, 8192, 512
#: Bounds of the sample and of the pivots, in rows and bytes.
SAMPLE, PIVOTS, BYTES = 4096, 2048, 16 << 20
#: Widening of angles for rounding; cosines this close to the limit are computed again with exact sums.
SLACK, CLOSE = 1e-6, 1e-9


def usable(kind: str) -> str:
    return f"vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> {kind}('inf')) AND exists(embedding, x -> x <> 0)"


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, the vector's bytes, its length and a 128-bit key of the bytes; negative zero is zero."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            flat = (lists.flatten().to_numpy().astype(kind) + 0).astype(kind)
            rows = [part.tobytes() for part in np.split(flat, ends[:-1])] if len(ends) else []
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            dims = pa.array(np.diff(ends, prepend=0), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary()), dims, pa.array(keys, pa.binary())], names=["vec_id", "v", "dim", "key"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary, dim int, key binary")


class Pivots:
    """Pivots of vectors of one length. Cells: the core of pivot j has the number ``base + 2 j``, its ring the next one."""

    def __init__(self, points: np.ndarray, base: int, reach: float):
        self.points, self.base, self.core = points, base, reach / 2 - SLACK
        self.apart = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.points.T, -1, 1))

    def home(self, angles: np.ndarray) -> np.ndarray:
        near = angles.argmin(1)
        return self.base + 2 * near + (angles[np.arange(len(near)), near] > self.core)


def choose(sample: np.ndarray, count: int, reach: float) -> np.ndarray:
    """Middles of spots that hold eight sample vectors or more, densest first, then vectors until there are ``count``; all over a reach apart."""
    near = np.concatenate([(sample[s : s + 512] @ sample.T >= math.cos(reach / 2)).sum(1) for s in range(0, len(sample), 512)])
    points = np.empty((0, sample.shape[1]))
    for i in np.argsort(-near, kind="stable"):
        if near[i] < 8 and len(points) >= count:
            break
        if len(points) >= PIVOTS or (len(points) and (points @ sample[i]).max() >= math.cos(reach)):
            continue
        middle = sample[sample @ sample[i] >= math.cos(reach / 2)].sum(0)
        points = np.vstack([points, middle / np.sqrt(middle @ middle)])
    return points


def pivots_of(classes: DataFrame, kind: str, reach: float) -> dict[int, Pivots]:
    """Pivots by length of vector, from a sample of at most SAMPLE rows and BYTES bytes in order of a hash."""
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    out, base = {}, 0
    for dim, count in sizes.items():
        most = max(8, min(SAMPLE, BYTES // (8 * dim)))
        raw = [bytes(r["v"]) for r in classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(most).select("v").collect()]
        points = choose(units(raw, kind), min(most, math.ceil(count / CELL)), reach)
        out[dim] = Pivots(points, base, reach)
        base += 2 * len(points)
    return out


class Cells:
    """What the cells hold: members, weight, smallest member and largest angle to the pivot."""

    def __init__(self, rows: list):
        self.of = {r["cell"]: (r["members"], r["weight"], r["least"], r["radius"]) for r in rows}

    def column(self, cells: np.ndarray, i: int, kind) -> np.ndarray:
        names, at = np.unique(cells, return_inverse=True)
        return np.array([self.of.get(int(c), (0, 0, 0, 0.0))[i] for c in names], kind)[at]


def meetings(own: Pivots, cells: Cells, vectors: np.ndarray, home: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors (rows) visit which rings and cores (columns: pivots), and which are linked with a whole core."""
    angles = own.angles(vectors)
    k = len(own.points)
    core, ring = own.base + 2 * np.arange(k), own.base + 2 * np.arange(k) + 1
    at, in_ring = (home - own.base) // 2, (home - own.base) % 2 == 1
    # Cores receive rings; of two cores, the later one receives the earlier.
    may = (cells.column(core, 0, np.int64) > 0) & (in_ring[:, None] | (np.arange(k) > at[:, None]))
    radius = cells.column(core, 3, np.float64)
    whole = may & (angles + radius <= reach - SLACK)
    to_core = may & ~whole & (angles - radius <= reach + SLACK)
    # Of two rings i < j, j receives if i + j is even.
    j = np.arange(k)
    receives = ((at[:, None] + j) % 2 == 0) == (at[:, None] < j)
    to_ring = (cells.column(ring, 0, np.int64) > 0) & in_ring[:, None] & receives & (j != at[:, None])
    to_ring &= angles - cells.column(ring, 3, np.float64) <= reach + SLACK
    cosines = vectors @ own.points.T
    to_ring &= cosines[np.arange(len(at)), at][:, None] - cosines <= (math.sin(min(reach, math.pi / 2)) + SLACK) * own.apart[at]
    return to_ring, to_core, whole


def assign(classes: DataFrame, pivots, kind: str) -> DataFrame:
    """Home cell and angle to its pivot; vectors of a length without pivots share a cell of that length."""

    def run(batches):
        for batch in batches:
            dims, raw = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            cell, angle = -dims.astype(np.int64) - 1, np.full(len(dims), np.pi)
            for dim in set(dims.tolist()) & set(pivots.value):
                at = np.flatnonzero(dims == dim)
                angles = pivots.value[dim].angles(units([raw[i] for i in at], kind))
                cell[at], angle[at] = pivots.value[dim].home(angles), angles.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "m", "v", "dim")), pa.array(cell), pa.array(angle)], names=["rep", "m", "v", "dim", "cell", "angle"])

    return classes.select("rep", "m", "v", "dim").mapInArrow(run, "rep long, m long, v binary, dim int, cell long, angle double")


def deal(homes: DataFrame, pivots, cells, kind: str, reach: float, block: int, facts: bool) -> DataFrame:
    """With ``facts``: (rep, links, root, whole) known without comparisons; else blocks with their members and visitors."""

    def known(own, vectors, home, rep, m):
        _, _, whole = meetings(own, cells.value, vectors, home, reach)
        weight, least = (cells.value.column(own.base + 2 * np.arange(len(own.points)), i, np.int64) for i in (1, 2))
        core = np.flatnonzero((home - own.base) % 2 == 0)
        j = (home[core] - own.base) // 2
        i, c = np.nonzero(whole)
        none = np.full(len(core), -1)
        return [np.concatenate(x) for x in ((rep[core], rep[i]), (weight[j] - m[core], weight[c]), (least[j], least[c]), (none, own.base + 2 * c), (m[core], m[i]))]

    def dealt(home, rep, own, vectors):
        """Row numbers with their cells and blocks, and whether they visit."""
        n = np.maximum(1, -(-cells.value.column(home, 0, np.int64) // block))
        part = rep % n
        out = [(np.arange(len(home)), home, part, np.zeros(len(home), bool))]
        ring = np.ones(len(home), bool) if own is None else (home - own.base) % 2 == 1
        later = np.where(ring, n - 1 - part, 0)
        i = np.repeat(np.arange(len(home)), later)
        out.append((i, home[i], part[i] + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later), np.ones(len(i), bool)))
        if own is not None:
            to_ring, to_core, _ = meetings(own, cells.value, vectors, home, reach)
            for to, side in ((to_ring, 1), (to_core, 0)):
                i, j = np.nonzero(to)
                target = own.base + 2 * j + side
                blocks = np.maximum(1, -(-cells.value.column(target, 0, np.int64) // block))
                each = np.repeat(np.arange(len(i)), blocks)
                out.append((i[each], target[each], np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks), np.ones(len(each), bool)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches):
        for big in batches:
            for s in range(0, big.num_rows, 1024):
                batch = big.slice(s, 1024)
                dims, raw = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
                for dim in sorted(set(dims.tolist())):
                    at = np.flatnonzero(dims == dim)
                    own = pivots.value.get(dim)
                    home, rep, m = (batch.column(c).to_numpy()[at] for c in ("cell", "rep", "m"))
                    vectors = units([raw[i] for i in at], kind) if own is not None else None
                    if not facts:
                        i, cell, part, visits = dealt(home, rep, own, vectors)
                        columns = [pa.array(cell), pa.array(part), pa.array(visits), pa.array(rep[i]), pa.array(m[i]), pa.array([raw[at[k]] for k in i], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "part", "visits", "rep", "m", "v"])
                    elif own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in known(own, vectors, home, rep, m)], names=["rep", "links", "root", "whole", "m"])

    schema = "rep long, links long, root long, whole long, m long" if facts else "cell long, part long, visits boolean, rep long, m long, v binary"
    return homes.mapInArrow(run, schema)


class Block:
    """Members of a block; vectors are streamed past it."""

    def __init__(self, rep: list, m: list, raw: list[bytes], kind: str, cosine: float, within: bool):
        self.rep, self.m, self.raw, self.kind, self.cosine = np.array(rep, np.int64), np.array(m, np.int64), raw, kind, cosine
        self.units = units(raw, kind)
        self.links = np.zeros(len(rep), np.int64)
        self.part = np.arange(len(rep))
        if within:
            for s in range(0, len(raw), VISITORS):
                hits = self._hits(self.units[s : s + VISITORS], raw[s : s + VISITORS])
                own = np.arange(len(hits)), s + np.arange(len(hits))
                hits[own] = False
                self._count(self.m[s : s + VISITORS], hits)
                hits[own] = hits.any(1)
                self._connect(hits)

    def _hits(self, vectors: np.ndarray, raw: list[bytes]) -> np.ndarray:
        cosines = vectors @ self.units.T
        hits = cosines >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(cosines - self.cosine) <= CLOSE), strict=True):
            x, y = (np.frombuffer(b, self.kind).astype(np.float64).tolist() for b in (raw[i], self.raw[j]))
            xy, xx, yy = (math.fsum(a * b for a, b in zip(*p, strict=True)) for p in ((x, y), (x, x), (y, y)))
            hits[i, j] = xy / math.sqrt(xx * yy) >= self.cosine if 0 < xx * yy < math.inf else hits[i, j]
        return hits

    def _count(self, m: np.ndarray, hits: np.ndarray) -> None:
        rows, cols = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
        self.links[cols] += m[rows] @ hits[np.ix_(rows, cols)]

    def _connect(self, hits: np.ndarray) -> None:
        """Members that one vector is linked with share a part, named by a smallest place; so do a member's earlier mates."""
        rows, cols = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
        if not len(rows):
            return
        hits = hits[np.ix_(rows, cols)]
        while True:
            least = np.where(hits, self.part[cols], len(self.part)).min(1)
            mine = np.minimum(self.part[cols], np.where(hits, least[:, None], len(self.part)).min(0))
            # What a member learns holds for all of its part.
            name = np.arange(len(self.part))
            np.minimum.at(name, self.part[cols], mine)
            now = name[self.part]
            if (now == self.part).all():
                return
            self.part = now

    def visit(self, rep: np.ndarray, m: np.ndarray, raw: list[bytes]):
        """(rep, links, root) of visitors linked with members."""
        hits = self._hits(units(raw, self.kind), raw)
        self._count(m, hits)
        self._connect(hits)
        some = np.flatnonzero(hits.any(1))
        return rep[some], (hits[some] @ self.m), self.rep[hits[some].argmax(1)]

    def members(self):
        """(rep, links, root) of the members, once all visitors have been."""
        part = self.part
        while (part[part] != part).any():
            part = part[part]
        return self.rep, self.links, self.rep[part]


def compare(dealt: DataFrame, kind: str, cosine: float, units_of: int) -> DataFrame:
    """rep, links and root: results of all blocks, each by a stream past its members. Only members of rings are compared with each other."""
    ordered = dealt.repartition(units_of, "cell", "part").sortWithinPartitions("cell", "part", "visits")

    def run(batches):
        key, rows, block, waiting = None, [], None, []

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=["rep", "links", "root"])

        def met():
            out = batch_of(block.visit(np.array([r[0] for r in waiting], np.int64), np.array([r[1] for r in waiting], np.int64), [r[2] for r in waiting]))
            waiting.clear()
            return out

        def start():
            rep, m, raw = map(list, zip(*rows, strict=True))
            within = key[0] < 0 or key[0] % 2 == 1
            rows.clear()
            return Block(rep, m, raw, kind, cosine, within)

        def end():
            nonlocal block
            if rows:
                block = start()
            if block is not None:
                if waiting:
                    yield met()
                yield batch_of(block.members())
            waiting.clear()
            block = None

        for batch in batches:
            for cell, part, visits, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "visits", "rep", "m", "v")), strict=True):
                if (cell, part) != key:
                    yield from end()
                    key = (cell, part)
                if not visits:
                    rows.append(row)
                    continue
                if rows:
                    block = start()
                if block is not None:
                    waiting.append(row)
                    if len(waiting) >= VISITORS:
                        yield met()
        yield from end()

    return ordered.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    reach = math.acos(cosine)
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    rows = stage(packed(vectors.where(usable("double" if double else "float")), kind), "vectors")
    members = rows.select("vec_id", "key").distinct()
    classes = members.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    # Several vectors of one vec_id need names of their own: a class is named by a number of its key where its first id is taken.
    named = stage(classes, "classes")
    taken = named.groupBy("first").agg(F.min("key").alias("winner"), F.count("*").alias("n"))
    named = named.join(taken, "first").select("key", "m", "first", F.when(F.col("key") == F.col("winner"), F.col("first")).otherwise(-F.abs(F.xxhash64("key")) - 1).alias("rep"))
    named = stage(named, "named")
    firsts = rows.join(named, "key").where("vec_id = first").select("rep", "m", "v", "dim")
    reps = stage(firsts.dropDuplicates(["rep"]), "representatives")

    found = pivots_of(reps, kind, reach)
    pivots = spark.sparkContext.broadcast(found)
    homes = stage(assign(reps, pivots, kind), "homes")
    held = homes.groupBy("cell").agg(F.count("*").alias("members"), F.sum("m").alias("weight"), F.min("rep").alias("least"), F.max("angle").alias("radius")).collect()
    cells = spark.sparkContext.broadcast(Cells(held))
    parts = max(1, sum(-(-r["members"] // block) for r in held))
    facts = stage(deal(homes, pivots, cells, kind, reach, block, True), "facts")
    met = stage(compare(deal(homes, pivots, cells, kind, reach, block, False), kind, cosine, min(parts, 20_000)), "met")

    # Members of a core are linked with the vectors that are linked with all of it.
    whole = facts.where("whole >= 0").groupBy("whole").agg(F.sum("m").alias("links"))
    given = homes.join(whole, homes.cell == whole.whole).select("rep", "links")
    links = facts.select("rep", "links").union(met.select("rep", "links")).union(given).groupBy("rep").agg(F.sum("links").alias("links"))
    component = components(facts.select("rep", "root").union(met.select("rep", "root")), "rep", "root")
    placed = stage(named.join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left").select("key", "first", "m", "links", F.coalesce("root", "rep").alias("part")), "placed")
    least = placed.groupBy("part").agg(F.min("first").alias("component"))
    known = rows.distinct().select("vec_id", "key").join(placed, "key").join(least, "part")
    known = known.select("vec_id", "key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component")
    return _returned(vectors, known, kind)


def _returned(vectors: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """Results on every row of the input, rows that link with nothing included."""
    good = F.expr(usable("double" if kind == "<f8" else "float"))
    rest = vectors.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = packed(vectors.where(good), kind).select("vec_id", "key").join(known, ["vec_id", "key"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    return rows.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
