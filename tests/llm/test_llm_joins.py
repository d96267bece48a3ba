"""Spelling variants, the metric range join and ranked search against brute force, with small blocks, hot groups and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import metricjoin, ranking, spelling
from gridloom.llm.common import LOWER, UPPER

TO_LOWER = str.maketrans(UPPER, LOWER)
LONG = "wordily wordilx Wordily " * 30_000


# Spelling variants


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _variants(docs, least_count=5, factor=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(TO_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}
    near = {w: [v for v in n if _one_apart(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _spelled(spark, docs, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("word", "n", "l", "head", "part", "root")})
    rows = spelling.variants(frame, **how).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("block", [3, 64, 8192])
def test_variants_against_brute_force(spark, block):
    """Dense neighbourhoods over three letters, one frequent beginning, repeated letters, both lengths."""
    rng = random.Random(block)
    pool = ["".join(rng.choices("abé", k=rng.choice([6, 7, 8]))) for _ in range(150)] + ["aaaaaa" + "".join(rng.choices("abc", k=rng.choice([0, 1, 2, 3]))) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(pool, weights=[1 / (j + 1) for j in range(len(pool))], k=400))) for i in range(12)]
    want = _variants(docs, 2)
    assert any(v[0] for v in want.values()) and _spelled(spark, docs, least_count=2, block=block) == want


def test_variants_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (None, "WORDILY " * 30), (3, LONG), (3, LONG), (4, "short a b c"), (5, "Über­ÜBERALL ÉCOLE× x" * 9), (6, "\x00 ẞtrassen ﬁnally naïveté naiveté " * 6)]
    want = _variants(docs)
    assert _spelled(spark, docs) == want and want["wordilx"][0] is None and want["naiveté"][3] == 1
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_roots_follow_long_paths(spark):
    """Five steps, each five times as frequent."""
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    docs = [(i, " ".join([w] * 2 * 6**i)) for i, w in enumerate(words)]
    got = _spelled(spark, docs, least_count=1)
    want = _variants(docs, 1)
    assert got == want and got["abcdefgh"][1] == "abcdwzyx"


# Metric range join


def _linked(vectors, cosine=0.95):
    """One result a (vec_id, vector): plain double loop."""
    ids = [v for v, _ in vectors]
    good = [i is not None and x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x) and any(x) for i, x in vectors]
    units = [[float(np.float32(c)) for c in x] if g else None for g, (_, x) in zip(good, vectors, strict=True)]
    units = [np.array(x) / math.sqrt(sum(c * c for c in x)) if x else None for x in units]
    link = {i: [j for j in range(len(ids)) if i != j and good[i] and good[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(len(ids))}
    out, seen = {}, {}
    for i in range(len(ids)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        least = min((ids[j] for j in group if ids[j] is not None), default=None)
        seen |= {j: least for j in group}
    return sorted(((ids[i], len(link[i]), seen[i], ids[i] is not None and ids[i] == seen[i]) for i in range(len(ids))), key=repr)


def _joined(spark, vectors, **how):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({c: F.lit(3) for c in ("cell", "rep", "m", "key", "v", "n_links", "label")})
    return sorted((tuple(r) for r in metricjoin.near_duplicates(frame.repartition(5), **how).collect()), key=repr)


def _cloud(seed, spots, singles, dim=12):
    """Tight spots, loose spots whose members are not all linked, chains, singles."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in spots:
        middle = rng.normal(size=dim)
        middle /= np.linalg.norm(middle)
        rows += list(middle + rng.normal(size=(size, dim)) * spread / math.sqrt(dim))
    rows += list(rng.normal(size=(singles, dim)))
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    rows += [a * math.cos(t) + b * math.sin(t) for t in np.arange(0, 2.5, 0.25)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in rows[k] * rng.choice([1, 1, 5])]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block,cell", [(7, 20), (64, 100), (8192, 4096)])
def test_range_join_against_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(metricjoin, "CELL", cell)
    vectors = _cloud(block, [(60, 0.05), (40, 0.15), (50, 0.3), (9, 0.2)], 120)
    want = _linked(vectors)
    assert _joined(spark, vectors, block=block) == want and max(n for _, n, _, _ in want) > 30


def test_cores_visit_cores(spark, monkeypatch):
    """Two spots a little more than the reach apart: partly linked through their near sides."""
    monkeypatch.setattr(metricjoin, "CELL", 10)
    rng = np.random.default_rng(3)
    rows = [[math.cos(t), math.sin(t), 0.001 * z] for t, z in zip(np.concatenate([rng.uniform(-0.1, 0.1, 60), 0.36 + rng.uniform(-0.1, 0.1, 60)]), rng.normal(size=120), strict=True)]
    vectors = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    assert _joined(spark, vectors, block=16) == _linked(vectors)


def test_equal_and_hot_vectors(spark):
    """A third of all rows are equal; another third lies in one spot and is never compared."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=16)
    vectors = [(i, [1.0] * 16) for i in range(0, 300)] + [(i, [float(x) for x in middle + rng.normal(size=16) * 0.03]) for i in range(300, 600)] + [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600, 900)]
    got = _joined(spark, vectors, block=32)
    assert got == _linked(vectors)


def test_range_join_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e30, 0.0]), (9, [1e-30, -0.0]), (10, [1.0]), (11, [1.0, 0.0, 0.0]), (12, [0.96, 0.28])]
    assert _joined(spark, odd) == _linked(odd)
    twice = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 1.0])]
    assert _joined(spark, twice) == _linked(twice)
    assert _joined(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert _joined(spark, []) == []


def test_limit_itself_is_linked(spark):
    """3-4-5 vectors: the cosine is 0.8 exactly, however its products are rounded."""
    vectors = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [4.0, 3.0]), (4, [4.0, 3.001])]
    got = {r[0]: r[1] for r in _joined(spark, vectors, cosine=0.8)}
    assert got[3] == 3 and got[4] == 2


# Ranked search


def _ranked(docs, items, k=20):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(TO_LOWER))
    bags = [(d, cut(t)) for d, t in docs]
    n_docs, length = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(cut(t))
    out = []
    for item, words in asked.items():
        rows = []
        for doc, bag in bags:
            tf, score = Counter(bag), 0
            for t in words:
                if tf[t]:
                    m = 75 + 25 * len(bag) * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if bare else doc, -score) for r, (score, bare, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def _searched(spark, docs, items, **how):
    clash = {c: F.lit(3) for c in ("n", "ids", "tf", "term", "rank", "score", "c")}
    frames = [spark.createDataFrame(rows, f"{c} long, text string").withColumns(clash) for c, rows in (("doc_id", docs), ("item_id", items))]
    return sorted((tuple(r) for r in ranking.search(frames[0].repartition(4), frames[1], **how).collect()), key=repr)


@pytest.mark.parametrize("width,docs_held,block", [(1, 5, 50_000), (16, 3, 30), (1024, 2048, 50_000)])
def test_search_against_brute_force(spark, monkeypatch, width, docs_held, block):
    """Narrow sketches share coordinates; small blocks; several blocks of items; copies give equal scores."""
    monkeypatch.setattr(ranking, "DOCS", docs_held)
    monkeypatch.setattr(ranking, "CHUNK", 2)
    rng = random.Random(width)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(9)] + [(9, docs[7][1])]
    assert _searched(spark, docs, items, k=5, width=width, block=block) == _ranked(docs, items, 5)


def test_search_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! \n"), (4, "One two 3"), (4, "One two 3"), (None, "one two 3"), (5, LONG), (6, "é É ß x y"), (-7, "two"), (8, "one ONE one")]
    items = [(1, None), (2, "!"), (3, "one ONE two"), (None, "two é"), (4, "unknown"), (5, "wordily x y"), (3, "3"), (6, LONG)]
    assert _searched(spark, docs, items) == _ranked(docs, items)
    assert _searched(spark, [], items) == [] == _searched(spark, docs, [])


def test_bounds_spare_documents():
    """Once k good documents are held, most others are ruled out by their bounds."""
    rng = np.random.default_rng(1)
    n, v = 2000, 400
    ids = [np.unique(rng.integers(0, v, 30)) for _ in range(n)]
    sizes = np.array([len(x) for x in ids])
    tf = np.ones(sizes.sum(), np.int64)
    known = [str(i).encode() for i in range(v)]
    coordinate = np.arange(v) % 1024
    rows = [{"item_id": 1, "term": known[i], "c": 1} for i in range(12)]
    items = ranking.Items(rows, {t: i for i, t in enumerate(known)}, np.arange(1, v + 1)[::-1] ** 2, coordinate, 1024)
    best = ranking.Best(1, 5)
    seen = ranking.rank_block(items, best, coordinate, np.arange(n), np.zeros(n, bool), np.full(n, 100), sizes, np.concatenate(ids), tf)
    assert len(best.doc[0]) == 5 and seen < n / 10
