"""Registered queries on whole small tables: against SQL, or against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from check import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridloom.llm import catalog, decontam, lines, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_registered():
    names = {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    for c in ("first_word", "last_word"):  # nullable long: the two libraries differ in how they show it
        if c in got:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert difference(got, want) is None


def _held_out(spark, query, label, con):
    got = catalog.QUERIES[query](spark, "/root/testdata/sf0.1").toPandas()
    n = connect("/root/testdata/sf0.1").execute(f"SELECT doc_id, {label} y FROM labels").df()
    assert len(got) == 10_000 and got.doc_id.is_unique and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    rows = got[got.held_out].merge(n, on="doc_id")
    order = rows.score.rank()
    ones = rows.y == 1
    return rows, (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_toxicity_held_out(spark, con):
    rows, auc = _held_out(spark, "op2_toxicity", "toxic", con)
    assert auc > 0.9
    assert (rows.predicted == (rows.score >= 0.5)).all()
    assert rows[rows.y == 0].predicted.mean() < 0.05


def test_quality_held_out(spark, con):
    rows, auc = _held_out(spark, "op10_quality", "quality", con)
    assert auc > 0.95
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert ((rows.predicted == 1) == (rows.y == 1)).mean() > 0.95


def test_sentencepiece_returns_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.op4_sentencepiece(spark, SF)
    assert got.count() == docs.count() == got.where("exact").count()
    texts = pieces.decode(got, pieces.read_model(catalog.MODEL))
    assert texts.exceptAll(docs.select("doc_id", "text")).isEmpty()


def _passages(docs, benchmark):
    """Documents that hold 13 consecutive words of an item, or a whole shorter item, word by word."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = {}
    for item, text in benchmark:
        words = cut(text)
        n = min(len(words), decontam.PASSAGE)
        for i in range(len(words) - n + 1):
            known.setdefault(tuple(words[i : i + n]), set()).add(item)
    sizes = {len(k) for k in known}
    return {(d, item) for d, text in docs for w in [cut(text)] for n in sizes for i in range(len(w) - n + 1) for item in known.get(tuple(w[i : i + n]), ())}


def test_decontamination_against_brute_force(spark, con):
    want = _passages(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in catalog.op8_decontaminate(spark, SF).collect()}
    assert want and got == want


def test_decontamination_runs_no_python(spark):
    plan = catalog.op8_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_pipeline_against_brute_force(spark, con):
    """Each stage on its predecessor's rows, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic = corpus_pipeline.toxic(spark, docs, SF)
    assert toxic.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in toxic.collect()}
    assert set(kept) <= set(rows) and len(kept) > 0.8 * len(rows)

    cleaned = corpus_pipeline.line_dedup(spark, toxic, SF)
    key = lambda t: t.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(catalog.UPPER, catalog.LOWER))
    uses = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")} if k)
    want = {d: "\n".join(x for x in t.split("\n") if uses[key(x)] < 10) for d, t in kept.items()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert cleaned.columns == docs.columns and got == {d: (t, len(t)) for d, t in want.items()}

    single = corpus_pipeline.near_dedup(spark, cleaned, SF)
    sets = {}
    for d, t in want.items():
        w = t.translate(str.maketrans(catalog.UPPER, catalog.LOWER)).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in single.collect()} == {d for d in ids if find(d) == d}

    left = corpus_pipeline.decontaminate(spark, single, SF)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    hit = {d for d, _ in _passages(before.items(), con.execute("SELECT item_id, text FROM benchmark").fetchall())}
    assert {r["doc_id"] for r in left.collect()} == set(before) - hit

    last = corpus_pipeline.encode(spark, left, SF)
    assert last.where("NOT exact").isEmpty() and last.count() == len(before) - len(hit)


def test_pipeline_query(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
    rows = entry.queries()["pipeline"](spark, SF)
    assert rows.where("exact").count() == rows.count() > 0


def test_line_dedup_keeps_the_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in lines.apply(docs, lines.bitmaps(docs, 1, 1, True)).select("rest.doc_id", "text").collect()}
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        out = []
        for x in (r["text"] or "").split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(catalog.UPPER, catalog.LOWER))
            if not k or k not in seen:
                out.append(x)
            seen.add(k)
        want[r["doc_id"]] = "\n".join(out)
    assert got == want


def test_inputs_are_read_whole(spark):
    """Row counts of the results that have a row per input row."""
    for name, table in (("op1_license_scan", "documents"), ("op3_url_filter", "pages"), ("op6_line_dedup", "documents"), ("op9_near_dedup", "documents")):
        assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert catalog.op5_exact_topk(spark, SF).groupBy("query_id").count().where(F.col("count") == 5).count() == n


def test_scores_do_not_depend_on_partitioning(spark):
    from gridloom.llm import quality, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    learn = ~toxicity.held_out(F.col("doc_id"))
    runs = []
    for n in (1, 5):
        stats = quality.measure(docs.repartition(n))
        runs.append({r["doc_id"]: r["score"] for r in quality.score(stats, quality.fit(stats, labels, learn)).collect()})
    assert np.allclose([runs[0][d] for d in sorted(runs[0])], [runs[1][d] for d in sorted(runs[0])], atol=1e-6)
