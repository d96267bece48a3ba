"""Tree ensembles, kept as plain tables and scored in Arrow batches.

Forests are grown a few trees at a time, so a forest can be put together from small ones, fitted side by side and kept when a
driver is lost. Shallow trees are grown by Spark ML, and what it has grown is read into arrays of nodes. Its tasks send a
full histogram for every open node, however few rows are left in it, so deep trees are grown from binned rows here: nodes of
many rows from sums over bins, one job a level, and each node of few rows by one task that gets its rows. Boosting grows its
trees from such sums too, since Spark ML has no patience, no penalty and no missing values. An ensemble is a row of bytes
that a scan can score.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch_path, stage_table

#: Packed trees that one pass over the rows sends to the executors, in bytes; opened they take about three times as much.
PASS_BYTES = 32 << 20


@dataclass
class Ensemble:
    """``base`` plus weighted trees; nodes of all trees in one set of arrays, children as places in it, leaves with feature -1.

    Values up to the threshold go left, and missing ones where ``gap`` says so.
    """

    base: float
    weight: np.ndarray
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gap: np.ndarray = None
    n_rounds: int = 0
    best_round: int = 0
    val_errors: list[float] = field(default_factory=list)

    def __post_init__(self):
        if self.gap is None:
            self.gap = np.zeros(len(self.feature), bool)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root, weight in zip(self.root, self.weight, strict=True):
            at, live = np.full(len(x), root), rows
            while len(live := live[self.feature[at[live]] >= 0]):
                here = at[live]
                cell = x[live, self.feature[here]]
                down = np.where(np.isnan(cell), self.gap[here], cell <= self.threshold[here])
                at[live] = np.where(down, self.left[here], self.right[here])
            out += weight * self.value[at]
        return out

    def packed(self) -> bytes:
        """All that ``predict`` needs: numbers that come often once, children by their distance, nothing of what inner nodes would say."""
        leaf, place, file = self.feature < 0, np.arange(len(self.feature)), io.BytesIO()
        left, right = np.where(leaf, 0, self.left - place), np.where(leaf, 0, self.right - self.left)
        limits, limit = np.unique(np.where(leaf, 0.0, self.threshold), return_inverse=True)
        values, value = np.unique(np.where(leaf, self.value, 0.0), return_inverse=True)
        small = {"feature": self.feature, "left": left, "right": right, "limit": limit, "value": value}
        np.savez(file, base=self.base, weight=self.weight, root=self.root, limits=limits, values=values, gap=np.packbits(self.gap.astype(bool)), **{k: _narrow(v) for k, v in small.items()})
        return file.getvalue()

    @classmethod
    def unpacked(cls, content: bytes) -> Ensemble:
        held = dict(np.load(io.BytesIO(content)))
        feature = held["feature"].astype(np.int32)
        left = np.arange(len(feature), dtype=np.int32) + held["left"].astype(np.int32)
        sons = (np.where(feature < 0, -1, x).astype(np.int32) for x in (left, left + held["right"].astype(np.int32)))
        gap = np.unpackbits(held["gap"], count=len(feature)).astype(bool)
        return cls(float(held["base"]), held["weight"], held["root"], feature, held["limits"][held["limit"]], *sons, held["values"][held["value"]], gap)


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    ends = [int(whole.min()), int(whole.max())] if len(whole) else [0]
    return whole.astype(np.result_type(*(np.min_scalar_type(e) for e in ends)))


def join_trees(parts: Sequence[Ensemble], base: float, weights: Sequence[float]) -> Ensemble:
    """One ensemble of all trees, in order, with new weights."""
    offsets = np.cumsum([0, *(len(p.feature) for p in parts)])

    def together(name: str, shift: bool = False) -> np.ndarray:
        return np.concatenate([getattr(p, name) + (o if shift else 0) for p, o in zip(parts, offsets)]) if parts else np.zeros(0, np.int32)

    return Ensemble(base, np.asarray(weights, float), together("root", True), together("feature"), together("threshold"), together("left", True), together("right", True), together("value"), together("gap").astype(bool))


def read_trees(model) -> list[Ensemble]:
    """The trees of a fitted forest, one ensemble each: nodes come in preorder, a right child after all of the left side."""
    out = []
    for tree in model.trees:
        feature, threshold, left, right, value, open_ = [], [], [], [], [], []
        for line in tree.toDebugString.splitlines()[1:]:
            words = line.split()
            if not words or words[0] == "Else":
                continue
            if open_:
                parent, side = open_.pop()
                side[parent] = len(feature)
            if words[0] == "If":
                open_ += [(len(feature), right), (len(feature), left)]
            feature.append(int(words[2]) if words[0] == "If" else -1)
            threshold.append(float(words[4].rstrip(")")) if words[0] == "If" else 0.0)
            value.append(float(words[1]) if words[0] == "Predict:" else 0.0)
            left.append(-1)
            right.append(-1)
        nodes = np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value)
        out.append(Ensemble(0.0, np.ones(1), np.zeros(1, np.int64), *nodes))
    return out


def concurrently(spark: SparkSession, jobs: Sequence[Callable], workers: int = 8) -> list:
    """Results of functions that start Spark jobs, at most ``workers`` at once, each in a scheduler pool of its own.

    With ``spark.scheduler.mode`` FAIR the pools share the executors evenly; otherwise jobs fill what others leave idle.
    """

    def pooled(job: Callable, name: str):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(pooled), job, f"fit-{i % workers}") for i, job in enumerate(jobs)]
        return [w.result() for w in waiting]


# Random forest


#: Levels up to which Spark ML grows a forest; bins of a feature in deeper ones, as many as Spark ML takes.
DENSE_DEPTH, FOREST_BINS = 8, 32
#: Rows of a node that one task completes; open nodes that a job sums up; of these, the ones compared at once.
NODE_ROWS, OPEN_NODES, COMPARED = 50_000, 128, 64
#: Rows times trees of a part, which is one row of the forest's table.
PART_ROWS = 250_000
#: What a deep forest can be asked for; other settings are left to Spark ML.
DEEP_SETTINGS = {"maxDepth", "minInstancesPerNode", "maxBins"}


def grow_forest(train: DataFrame, path: str | None = None, part_trees: int | None = None, workers: int = 8, **params) -> DataFrame:
    """A forest as a table (part, n_trees, packed), grown as small forests with seeds of their own, side by side.

    Every part is written below ``path`` when it is ready; a run that finds parts there, after a lost driver, grows only
    the others. Parts are the same in every run and order. ``part_trees`` is 5 by default, for deep trees as many as make
    PART_ROWS with the rows, 1 to 25.
    """
    spark = train.sparkSession
    settings = dict(params)
    total, seed = settings.pop("numTrees"), settings.pop("seed", 0)
    path = path or scratch_path(spark, "forest")
    deep = None
    if settings.get("maxDepth", 5) > DENSE_DEPTH and not set(settings) - DEEP_SETTINGS and settings.get("maxBins", FOREST_BINS) <= MISSING:
        deep = _Deep(train, share=1 / 3 if total > 1 else 1.0, **settings)
        part_trees = part_trees or max(1, min(25, PART_ROWS // deep.n))
    part_trees = part_trees or 5
    sizes = [min(part_trees, total - s) for s in range(0, total, part_trees)]

    def grow(part: int) -> None:
        target = f"{path}/part={part}"
        if _ready(spark, target):
            return
        if deep:
            row = deep.grow(sizes[part], seed + 1000 * part)
        else:
            model = RandomForestRegressor(numTrees=sizes[part], seed=seed + 1000 * part, **settings).fit(train)
            trees = join_trees(read_trees(model), 0.0, np.ones(sizes[part]))
            row = spark.createDataFrame([(sizes[part], bytearray(trees.packed()))], "n_trees int, packed binary").coalesce(1)
        row.write.mode("overwrite").parquet(target)

    concurrently(spark, [lambda p=p: grow(p) for p in range(len(sizes))], workers)
    if deep:
        deep.close()
    return spark.read.schema("n_trees int, packed binary, part int").parquet(path).where(F.col("part") < len(sizes))


def _drawn_often(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree: with replacement, as many rows as there are on average."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(float)


def _some_features(rng: np.random.Generator, nodes: int, width: int, share: float) -> np.ndarray:
    """The features that each node may be split by, drawn without replacement."""
    few = max(1, int(np.ceil(share * width)))
    return np.argsort(rng.random((nodes, width)), axis=1)[:, :few]


def _sums_by_bin(at: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, features: np.ndarray, size: int) -> np.ndarray:
    """Sums of labels and weights (kind, node, place in ``features``, bin) of rows that lie in nodes ``at``."""
    return _sums_of(at, np.minimum(np.take_along_axis(bins, features[at], 1), size - 1), label, weight, len(features), size)


def _sums_of(at: np.ndarray, cell: np.ndarray, label: np.ndarray, weight: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """The same of rows whose bins by place are ``cell``."""
    few = cell.shape[1]
    cell = (cell + np.arange(0, nodes * few * size, size).reshape(nodes, few)[at]).ravel()
    sums = (np.bincount(cell, np.repeat(x, few), nodes * few * size) for x in (weight * label, weight))
    return np.array(list(sums)).reshape(2, nodes, few, size)


def _best_splits(h: np.ndarray, least: int, total: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each node of sums ``h``: whether anything is gained, the best (place, cut), the first on ties, and sums of the node and of its left side."""
    total = h[:, :, 0].sum(2).T if total is None else total
    left, rows = h[..., :-1].cumsum(3), np.arange(h.shape[1])
    g, n = left
    others = total[:, 1, None, None] - n
    score = total[:, 0, None, None] - g
    score *= score
    score /= np.maximum(others, 1)
    score += g * g / np.maximum(n, 1)
    score[np.minimum(n, others) < max(least, 1)] = -np.inf
    score = score.reshape(len(rows), -1)
    best, whole = score.argmax(1), total[:, 0] ** 2 / np.maximum(total[:, 1], 1)
    place, cut = np.divmod(best, left.shape[3])
    return score[rows, best] - whole > 1e-9 * (1 + whole), place, cut, total, left[:, rows, place, cut].T


def _best_of_few(h: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The same for nodes of few rows, from the bins that have rows only: a cut behind an empty bin is the one before it."""
    shape, used = h.shape[1:3], h[1] > 0
    held = np.count_nonzero(used, axis=2).ravel()
    most, cell = max(2, int(held.max())), np.flatnonzero(used)
    to = np.arange(len(cell)) + np.repeat(np.arange(len(held)) * most - (np.cumsum(held) - held), held)
    few, cuts = np.zeros((2, len(held) * most)), np.zeros(len(held) * most, np.intp)
    few[0, to], few[1, to], cuts[to] = h[0].ravel()[cell], h[1].ravel()[cell], cell % h.shape[3]
    ok, place, cut, total, left = _best_splits(few.reshape(2, *shape, most), least, h[:, :, 0].sum(2).T)
    return ok, place, cuts.reshape(*shape, most)[np.arange(shape[0]), place, cut], total, left


def complete(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, depth: int, least: int, share: float, size: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, right, value) of the nodes of a tree grown to its end over few rows; leaves have feature -1."""
    width, cells = bins.shape[1], np.minimum(bins, size - 1).ravel()
    first = np.arange(0, len(cells), width)  # of each row; rows that are still open change places, cells never
    feature, cut, left, value = (np.full(1, -1), np.zeros(1, int), np.full(1, -1), np.full(1, np.average(label, weights=weight)))
    at, nodes = np.zeros(len(label), int), np.zeros(1, int)  # each row's place among the open nodes
    for _ in range(depth):
        # Nodes of like size are compared side by side: each takes as long as the largest beside it.
        held, features = np.bincount(at, minlength=len(nodes)), _some_features(rng, len(nodes), width, share)
        by_size = np.argsort(held, kind="stable")
        rank = np.argsort(by_size)
        order = np.argsort(rank[at], kind="stable")
        first, label, weight, at = first[order], label[order], weight[order], at[order]
        ends, found = np.cumsum([0, *held[by_size]]), []
        for s in range(0, len(nodes), COMPARED):
            group = by_size[s : s + COMPARED]
            here, own = slice(ends[s], ends[s + len(group)]), features[group]
            node = rank[at[here]] - s
            h = _sums_of(node, cells[first[here, None] + own[node]], label[here], weight[here], len(group), size)
            ok, place, k, total, side = (_best_of_few if held[group[-1]] < size / 2 else _best_splits)(h, least)
            found.append((ok, own[np.arange(len(ok)), place], k, side, total - side))
        ok, by, k, one, other = (np.concatenate(x)[rank] for x in zip(*found, strict=True))
        if not ok.any():
            break
        sons = np.stack([one[ok], other[ok]], 1).reshape(-1, 2)  # left and right of each split node in turn
        feature[nodes[ok]], cut[nodes[ok]], left[nodes[ok]] = by[ok], k[ok], len(feature) + 2 * np.arange(ok.sum())
        made = len(feature) + np.arange(len(sons))
        feature, cut, left, value = (np.append(x, y) for x, y in ((feature, np.full(len(sons), -1)), (cut, np.zeros(len(sons), int)), (left, np.full(len(sons), -1)), (value, sons[:, 0] / sons[:, 1])))
        # A son of fewer rows than two leaves need, or whose labels are all the same, stays a leaf.
        live = ok[at]
        first, label, weight, at = first[live], label[live], weight[live], at[live]
        at = 2 * (np.cumsum(ok) - 1)[at] + (cells[first + by[at]] > k[at])
        low, high = np.full(len(sons), np.inf), np.full(len(sons), -np.inf)
        np.minimum.at(low, at, label)
        np.maximum.at(high, at, label)
        open_ = (sons[:, 1] >= 2 * max(least, 1)) & (high > low)
        live, nodes = open_[at], made[open_]
        first, label, weight, at = first[live], label[live], weight[live], (np.cumsum(open_) - 1)[at[live]]
        if not len(nodes):
            break
    return feature, cut, left, np.where(left < 0, -1, left + 1), value


class _Deep:
    """What the parts of a deep forest share: its rows, binned and in blocks."""

    def __init__(self, train: DataFrame, share: float, maxDepth: int, minInstancesPerNode: int = 1, maxBins: int = FOREST_BINS):
        rows = train.withColumn("split", F.lit("train"))
        self.n, mean, spread = rows.agg(F.count("label"), F.avg("label"), F.stddev_pop("label")).first()
        if not self.n:
            raise ValueError("a forest needs rows to learn from")
        self.mean, self.spread = float(mean), float(spread) or 1.0
        self.share, self.depth, self.least, self.size = share, maxDepth, minInstancesPerNode, maxBins + 1
        cuts = cut_points(rows, maxBins)
        # A cut behind the last stands for all known values.
        self.limits = np.stack([np.pad(c, (0, self.size - len(c)), constant_values=np.inf) for c in cuts])
        self.blocks = pack_blocks(rows, cuts, 0.0)
        self.kept = _kept(self.blocks) if self.n > NODE_ROWS else None

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()

    def tops(self, trees: int, seed: int) -> tuple[list[Grown], list[list[tuple[int, int]]]]:
        """The upper part of each tree, its nodes of more than NODE_ROWS rows split, and the (node, levels left) to complete."""
        tops: list[Grown] = [Grown() for _ in range(trees)]
        todo: list[list[tuple[int, int]]] = [[] for _ in range(trees)]
        if self.n <= NODE_ROWS:
            return tops, [[(0, self.depth)] for _ in range(trees)]
        rng, frontier = np.random.default_rng([seed, trees]), [(t, 0) for t in range(trees)]
        for level in range(self.depth):
            after = []
            for s in range(0, len(frontier), OPEN_NODES):
                group = frontier[s : s + OPEN_NODES]
                features = _some_features(rng, len(group), len(self.limits), self.share)
                h = self._level(tops, group, features, seed)
                ok, place, cut, total, left = _best_splits(h, self.least)
                for i, (t, node) in enumerate(group):
                    if not level:
                        tops[t].value[0] = float(total[i, 0] / max(total[i, 1], 1))
                    if ok[i]:
                        sides = left[i], total[i] - left[i]
                        sons = tops[t].split(node, int(features[i, place[i]]), int(cut[i]), False, tuple(float(x[0] / x[1]) for x in sides))
                        for son, side in zip(sons, sides, strict=True):
                            if side[1] > NODE_ROWS:
                                after.append((t, son))
                            elif level + 1 < self.depth:
                                todo[t].append((son, self.depth - level - 1))
            frontier = after
            if not frontier:
                break
        return tops, todo

    def _level(self, tops: list[Grown], group: list[tuple[int, int]], features: np.ndarray, seed: int) -> np.ndarray:
        size, mean, spread = self.size, self.mean, self.spread
        walked = {t: tops[t] for t, _ in group}
        shape = (2, *features.shape, size)

        def per_block(block, train, label, pred, bins):
            out = np.zeros(shape)
            for t, tree in walked.items():
                own = [i for i, (u, _) in enumerate(group) if u == t]
                place = np.full(len(tree.feature), -1)
                place[[group[i][1] for i in own]] = np.arange(len(own))
                often, at = _drawn_often(seed, t, block, len(label)), place[tree.walk(bins)]
                live = np.flatnonzero((at >= 0) & (often > 0))
                out[:, own] = _sums_by_bin(at[live], bins[live], (label[live] - mean) / spread, often[live], features[own], size)
            return out.ravel()

        return _summed(self.kept, per_block, int(np.prod(shape))).reshape(shape)

    def grow(self, trees: int, seed: int) -> DataFrame:
        """(n_trees, packed): a row of so many trees. A group is the rows of one node, NODE_ROWS at most; a task puts the nodes together."""
        mean, spread, size, share, least, limits = self.mean, self.spread, self.size, self.share, self.least, self.limits
        tops, todo = self.tops(trees, seed)
        levels = [dict(nodes) for nodes in todo]

        def deal(batches):
            for batch in batches:
                for block, _, label, _, bins in _blocks_of([batch]):
                    for t, tree in enumerate(tops):
                        often, at = _drawn_often(seed, t, block, len(label)), tree.walk(bins)
                        for node in np.unique(at).tolist():
                            own = np.flatnonzero((at == node) & (often > 0)) if node in levels[t] else at[:0]
                            if len(own):
                                row = t, node, block, len(own), ((label[own] - mean) / spread).tobytes(), often[own].tobytes(), bins[own].tobytes()
                                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["tree", "node", "block", "n", "label", "often", "bins"])

        def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = (int(k) for k in key)
            pdf = pdf.sort_values("block")
            label, often = (np.frombuffer(b"".join(pdf[c])) for c in ("label", "often"))
            bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(label), -1)
            feature, cut, left, right, value = complete(bins, label, often, levels[t][node], least, share, size, np.random.default_rng([seed, t, node]))
            limit = np.where(feature < 0, 0.0, limits[np.maximum(feature, 0), cut])
            nodes = feature.astype(np.int32), limit, left.astype(np.int32), right.astype(np.int32), mean + spread * value
            return pd.DataFrame({"tree": [t], "node": [node], "packed": [Ensemble(0.0, np.ones(1), np.zeros(1, np.int64), *nodes).packed()]})

        def together(batches):
            found: list[dict[int, Ensemble]] = [{} for _ in tops]
            for batch in batches:
                for t, node, packed in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "packed")), strict=True):
                    found[t][node] = Ensemble.unpacked(packed)
            whole = join_trees([_with_subtrees(top, limits, mean, spread, own) for top, own in zip(tops, found, strict=True)], 0.0, np.ones(len(tops)))
            yield pa.RecordBatch.from_arrays([pa.array([len(tops)], pa.int32()), pa.array([whole.packed()], pa.binary())], names=["n_trees", "packed"])

        dealt = self.blocks.mapInArrow(deal, "tree int, node long, block long, n int, label binary, often binary, bins binary")
        parts = dealt.groupBy("tree", "node").applyInPandas(finish, "tree int, node long, packed binary")
        return parts.repartition(1).mapInArrow(together, "n_trees int, packed binary")


def _with_subtrees(top: Grown, limits: np.ndarray, mean: float, spread: float, subtrees: dict[int, Ensemble]) -> Ensemble:
    """One tree of a top and the trees that some of its leaves have become; a subtree's root takes the leaf's place."""
    feature, left, right = (np.array(x, np.int32) for x in (top.feature, top.left, top.right))
    limit, value = np.where(feature < 0, 0.0, limits[np.maximum(feature, 0), top.cut]), mean + spread * np.array(top.value)
    parts, size = [(feature, limit, left, right, value)], len(feature)
    for node, tree in sorted(subtrees.items()):
        # The root goes to the leaf's place, the others behind what is there.
        sons = [np.where(x < 0, -1, x + size - 1).astype(np.int32) for x in (tree.left, tree.right)]
        own = tree.feature, tree.threshold, *sons, tree.value
        for whole, x in zip(parts[0], own, strict=True):
            whole[node] = x[0]
        parts.append(tuple(x[1:] for x in own))
        size += len(tree.feature) - 1
    return Ensemble(0.0, np.ones(1), np.zeros(1, np.int64), *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _ready(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def passes(table: DataFrame, order: Sequence[str], most: int = PASS_BYTES) -> list[list]:
    """Keys of a model table in groups of at most ``most`` packed bytes, a larger one alone."""
    groups, size = [], most
    for row in table.select(*order, F.coalesce(F.length("packed"), F.lit(0)).alias("_size")).orderBy(*order).collect():
        if size + row["_size"] > most:
            groups.append([])
            size = 0
        groups[-1].append(tuple(row[c] for c in order))
        size += row["_size"]
    return groups


def score_forest(forest: DataFrame, vectors: DataFrame, most: int = PASS_BYTES) -> DataFrame:
    """The rows with ``prediction``, the mean over all trees: small forests weigh by their number of trees.

    A pass over the rows holds trees of at most ``most`` bytes; a larger forest takes several, each staged.
    """
    total = forest.agg(F.sum("n_trees")).first()[0]
    rows, groups = _open(vectors), passes(forest, ["part"], most)
    for i, group in enumerate(groups):
        held = [Ensemble.unpacked(bytes(r["packed"])) for r in forest.where(F.col("part").isin([g[0] for g in group])).orderBy("part").collect()]
        rows = _add(rows, join_trees(held, 0.0, np.full(sum(len(h.root) for h in held), 1 / total)))
        if i + 1 < len(groups):
            rows = stage_table(rows, "scored")
    return rows.drop("_x")


def score_ensemble(model: Ensemble, vectors: DataFrame) -> DataFrame:
    """The rows with ``prediction``."""
    return _add(_open(vectors), model).drop("_x")


def _open(vectors: DataFrame) -> DataFrame:
    return vectors.select(*[c for c in vectors.columns if c != "features"], vector_to_array("features").alias("_x"), F.lit(0.0).alias("prediction"))


def _add(rows: DataFrame, trees: Ensemble) -> DataFrame:
    """Rows with what the trees say added to ``prediction``."""
    shared, names = rows.sparkSession.sparkContext.broadcast(trees.packed()), rows.columns

    def run(batches):
        trees = Ensemble.unpacked(shared.value)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
                told = pa.array(batch.column("prediction").to_numpy() + trees.predict(x))
                yield pa.RecordBatch.from_arrays([told if n == "prediction" else batch.column(n) for n in names], names=names)

    return rows.mapInArrow(run, rows.schema)


# Boosting

#: Rows of a block, bins of a feature (one more for missing), sums that reach the driver from one job.
BLOCK, BINS, MISSING, GROUPS = 8192, 64, 255, 16
#: Chunks of rounds between two stagings.
STAGED = 5
BLOCKS = "block long, n int, train binary, label binary, pred binary, bins binary"


def cut_points(vectors: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of every feature, at quantiles of its known train values; a value belongs to the first cut not below it."""
    rows = _open(vectors.where(F.col("split") == "train"))
    width = rows.select(F.max(F.size("_x"))).first()[0] or 0
    # One array for all features: a list would be turned into literals again for each of them.
    share = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    known = [F.when(~F.isnan(F.col("_x")[i]), F.col("_x")[i]) for i in range(width)]
    found = rows.agg(*[F.percentile_approx(k, share, 10_000).alias(f"q{i}") for i, k in enumerate(known)]).first() if width else []
    return [np.unique(np.array(q or [], float)) for q in found]


def pack_blocks(vectors: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Train and val rows in blocks: which are train, labels, what is predicted so far, and the bin of every feature in a byte."""

    def run(batches):
        place = TaskContext.get().partitionId() << 20
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                x = part.column("_x").flatten().to_numpy().reshape(part.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8)
                bins[np.isnan(x)] = MISSING
                row = [place, part.num_rows, part.column("train").to_numpy(zero_copy_only=False).tobytes(), part.column("label").to_numpy().tobytes(), np.full(part.num_rows, base).tobytes(), bins.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])
                place += 1

    used = _open(vectors.where(F.col("split").isin("train", "val"))).select((F.col("split") == "train").alias("train"), "label", "_x")
    return stage_table(used.mapInArrow(run, BLOCKS), "blocks")


@dataclass
class Grown:
    """A tree over bins while it grows: nodes with feature -1 are leaves; ``gap`` sends missing values to the left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    gap: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gap: bool, values: tuple[float, float]) -> list[int]:
        sons = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.cut[node], self.gap[node], self.left[node], self.right[node] = feature, cut, gap, *sons
        for value in values:
            for column, x in ((self.feature, -1), (self.cut, 0), (self.gap, False), (self.left, -1), (self.right, -1), (self.value, value)):
                column.append(x)
        return sons

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, cut, gap, left, right = (np.array(x) for x in (self.feature, self.cut, self.gap, self.left, self.right))
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(live := live[feature[at[live]] >= 0]):
            here = at[live]
            b = bins[live, feature[here]]
            at[live] = np.where(np.where(b == MISSING, gap[here], b <= cut[here]), left[here], right[here])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.walk(bins)]

    def unbinned(self, cuts: list[np.ndarray]) -> Ensemble:
        # A cut behind the last stands for all known values.
        limit = [np.append(c, np.inf)[k] if f >= 0 else 0.0 for f, k in zip(self.feature, self.cut, strict=True) for c in [cuts[max(f, 0)]]]
        nodes = np.array(self.feature, np.int32), np.array(limit, float), np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value)
        return Ensemble(0.0, np.ones(1), np.zeros(1, np.int64), *nodes, np.array(self.gap))


def _blocks_of(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            yield _opened(batch.column(c)[r].as_py() for c in batch.schema.names)


def _opened(row) -> tuple:
    block, n, train, label, pred, bins = row
    return block, np.frombuffer(train, bool), np.frombuffer(label), np.frombuffer(pred), np.frombuffer(bins, np.uint8).reshape(n, -1)


def _kept(blocks: DataFrame):
    """The blocks as an RDD that executors keep: a level is one short job without a plan."""
    return blocks.rdd.map(lambda r: (r[0], r[1], *(bytes(c) for c in r[2:]))).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(blocks, per_block: Callable, width: int) -> np.ndarray:
    """Sum of one vector a task; of many tasks in groups first, so the driver gets GROUPS vectors at most."""

    def run(rows):
        total = np.zeros(width)
        for row in rows:
            total += per_block(*_opened(row))
        yield total.tobytes()

    def merge(parts):
        total = np.zeros(width)
        for part in parts:
            total += np.frombuffer(part)
        yield total.tobytes()

    sums = blocks.mapPartitions(run)
    if blocks.getNumPartitions() > GROUPS:
        sums = sums.coalesce(GROUPS, shuffle=True).mapPartitions(merge)
    return sum((np.frombuffer(part) for part in sums.collect()), np.zeros(width))


@dataclass
class Drawn:
    """A block's rows as a tree sees them: predicted (``pred``) and ``told`` since by the first ``n_told`` trees, the rows drawn for tree ``number``, their cells and residuals."""

    pred: np.ndarray
    told: np.ndarray
    n_told: int = 0
    number: int = -1
    own: np.ndarray = None
    cells: np.ndarray = None
    left: np.ndarray = None
    val: np.ndarray = None

    def size(self) -> int:
        return sum(a.nbytes for a in (self.pred, self.told, self.own, self.cells, self.left, self.val) if a is not None)


#: Of this Python worker, the latest last; a block that is not held is drawn again, with the same result.
_DRAWN: dict[tuple, Drawn] = {}


def drawn(key: tuple, block: int, train, label, pred, bins, walked: Sequence[Grown], chunk: int, step: float, columns: np.ndarray, number: int, seed: int, rate: float, most: int = 64 << 20) -> Drawn:
    """The block's rows for tree ``number`` after the trees ``walked``, added up ``chunk`` at a time; up to ``most`` bytes are held for the next level."""
    held = _DRAWN.pop((key, block), None)
    if held is None or held.n_told > len(walked):
        held = Drawn(pred, np.zeros(len(label)))
    if held.number != number:
        for tree in walked[held.n_told :]:
            held.told, held.n_told = held.told + tree.predict(bins), held.n_told + 1
            if held.n_told % chunk == 0:
                held.pred, held.told = held.pred + step * held.told, np.zeros(len(label))
        left = label - held.pred - step * held.told
        own = np.flatnonzero(train & (np.random.default_rng([seed, number, block]).random(len(train)) < rate))
        held.number, held.own, held.val = number, own, left[~train]
        held.cells = np.arange(len(columns)) * (BINS + 1) + np.minimum(bins[own][:, columns], BINS)
        held.left = left[own]
    _DRAWN[key, block] = held
    total = sum(h.size() for h in _DRAWN.values())
    while total > most and _DRAWN:
        total -= _DRAWN.pop(next(iter(_DRAWN))).size()
    return held


def _best_split(h: np.ndarray, penalty: float, least: int) -> tuple | None:
    """Best (feature, cut, gap, left sum, left count) of a node's sums (feature, bin, kind), the first on ties; None if nothing is gained."""
    known, lost = h[:, :BINS].cumsum(1), h[:, BINS:]
    total = h[0].sum(0)
    gains = []
    for left in (known, known + lost):
        right = total - left
        ok = (left[..., 1] >= max(least, 1)) & (right[..., 1] >= max(least, 1))
        gain = left[..., 0] ** 2 / np.maximum(left[..., 1] + penalty, 1e-12) + right[..., 0] ** 2 / np.maximum(right[..., 1] + penalty, 1e-12)
        gains.append(np.where(ok, gain - total[0] ** 2 / max(total[1] + penalty, 1e-12), -np.inf))
    gap, feature, cut = np.unravel_index(int(np.argmax(gains)), (2, len(h), BINS))
    if not gains[gap][feature, cut] > 1e-9 * (1 + total[0] ** 2 / max(total[1], 1)):
        return None
    return int(feature), int(cut), bool(gap), *(known[feature, cut] + (lost[feature, 0] if gap else 0))


def boost(
    vectors: DataFrame, rounds: int, step: float, patience: int | None = 50, chunk: int = 10, seed: int = 0, maxDepth: int = 6,
    subsamplingRate: float = 1.0, columnRate: float = 1.0, penalty: float = 1.0, minInstancesPerNode: int = 1,
) -> Ensemble:
    """Additive trees, each grown on the residual of all before it and shrunk by ``step``, from the mean of the train labels.

    Features are binned once. A level of a tree is one job: tasks add up residuals and rows by node, feature and bin, the
    driver compares the splits. A leaf says the sum of its residuals divided by its rows plus ``penalty``; missing values
    go to the side that gains more. Rows and columns are drawn anew for every tree, by ``seed`` and place.

    With ``patience`` the error on the val split is taken after every round; growing ends as soon as so many rounds have
    passed without a new minimum, and the ensemble is cut back to the round of the smallest error (the first on ties).
    What is predicted is added up by ``chunk`` rounds and staged after STAGED chunks, so a task never walks more trees
    than those; what a worker holds of its blocks (``drawn``) spares it the trees it has walked.
    """
    base = float(vectors.where(F.col("split") == "train").agg(F.avg("label")).first()[0] or 0.0)
    cuts = cut_points(vectors)
    blocks = pack_blocks(vectors, cuts, base)
    kept, fit = _kept(blocks), uuid.uuid4().hex
    trees: list[Grown] = []
    made: list[Grown] = []
    errors: list[float] = []
    width = max(1, round(columnRate * len(cuts)))

    def level(tree: Grown, frontier: list[int], columns: np.ndarray, number: int) -> np.ndarray:
        place = np.full(len(tree.feature), -1)
        place[frontier] = np.arange(len(frontier))
        size, walked, key = len(frontier) * len(columns) * (BINS + 1), list(made), (fit, len(trees))

        def per_block(block, train, label, pred, bins):
            held = drawn(key, block, train, label, pred, bins, walked, chunk, step, columns, number, seed, subsamplingRate)
            at = place[tree.walk(bins[held.own])]
            live = at >= 0
            cell = (at[live, None] * len(columns) * (BINS + 1) + held.cells[live]).ravel()
            sums = np.bincount(cell, np.repeat(held.left[live], len(columns)), size), np.bincount(cell, minlength=size)
            return np.concatenate([np.stack(sums, 1).ravel(), [held.val @ held.val, len(held.val)]])

        return _summed(kept, per_block, 2 * size + 2)

    while True:
        number = len(trees) + len(made)
        columns = np.sort(np.random.default_rng([seed, number]).permutation(len(cuts))[:width])
        tree, frontier = Grown(), [0]
        for depth in range(max(1, maxDepth)):
            sums = level(tree, frontier, columns, number)
            if not depth and patience and number:
                errors.append(float(np.sqrt(sums[-2] / sums[-1])) if sums[-1] else float("nan"))
            if not depth and (number >= rounds or (patience and best_round(errors, patience)[1])):
                frontier = []
                break
            cells, after = sums[:-2].reshape(len(frontier), len(columns), BINS + 1, 2), []
            if not depth:
                total = cells[0, 0].sum(0)
                tree.value[0] = float(total[0] / max(total[1] + penalty, 1e-12))
            for node, h in zip(frontier, cells, strict=True):
                best = _best_split(h, penalty, minInstancesPerNode) if maxDepth else None
                if best:
                    feature, cut, gap, g, n = best
                    rest = h[0].sum(0) - [g, n]
                    after += tree.split(node, int(columns[feature]), cut, gap, (float(g / (n + penalty)), float(rest[0] / (rest[1] + penalty))))
            frontier = after
            if not frontier:
                break
        if number >= rounds or (patience and best_round(errors, patience)[1]):
            break
        made.append(tree)
        if len(made) == STAGED * chunk:
            blocks = _advanced(blocks, made, step, chunk)
            kept.unpersist()
            kept, trees, made = _kept(blocks), trees + made, []
    kept.unpersist()
    trees += made
    best = best_round(errors, patience)[0] if patience else len(trees)
    out = join_trees([t.unbinned(cuts) for t in trees[:best]], base, np.full(best, step))
    out.n_rounds, out.best_round, out.val_errors = len(trees), best, errors
    return out


def _advanced(blocks: DataFrame, made: list[Grown], step: float, chunk: int) -> DataFrame:
    """Blocks with what the trees of some chunks say added to what is predicted, chunk by chunk."""

    def told(pred: np.ndarray, bins: np.ndarray) -> np.ndarray:
        for s in range(0, len(made), chunk):
            pred = pred + step * sum((t.predict(bins) for t in made[s : s + chunk]), np.zeros(len(pred)))
        return pred

    def run(batches):
        for batch in batches:
            pred = [told(p, bins).tobytes() for _, _, _, p, bins in _blocks_of([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(pred, pa.binary()) if n == "pred" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return stage_table(blocks.mapInArrow(run, BLOCKS), "boosted")


def best_round(errors: Sequence[float], patience: int | None) -> tuple[int, bool]:
    """Rounds up to the first smallest error before ``patience`` rounds went by without a new one, and whether they did.

    Without a val row there is no error to go by: all rounds count.
    """
    if not np.isfinite(errors).any():
        return len(errors), False
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif patience and i - best >= patience:
            return best + 1, True
    return best + 1, False
