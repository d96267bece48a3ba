"""Hand cases and brute force for the operators: odd rows, ties, empty tables, clashing columns, hot groups."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import catalog, chat, common, decontam, licenses, lines, minhash, pieces, quality, topk, toxicity, urls

LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr " * 20_000
ODD = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "Released under the MIT License."), (5, LONG), (6, "one two three"), (6, "one two three"),
    (7, "ONE two\x0bthree"), (None, "no id here at all, sorry"), (8, "\x00 \u2581 é\u0301 \U0001f600 <|x|> \\ ###"), (9, "!" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows in a frame whose further columns bear names that operators use inside."""
    extra = {c: F.lit(7) for c in "n_words score kept keep tag doc pos rep bucket stats y w h1 window rest lang".split()}
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def sf(odd, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "short"), (None, "a b c d e f g"), (3, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"op3_url_filter", "op5_exact_topk", "op7_chat_format", "op11_spelling_variants", "op12_embedding_dedup", "op13_ranked_search"}))
def test_odd_rows(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    if name != "op8_decontaminate":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in ODD)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(catalog.QUERIES[name](spark, empty).collect()) == (name == "op7_chat_format")


def test_pipeline_on_odd_and_empty(spark, sf, empty, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf)
        assert docs.columns == odd.columns, name
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert None in ids
    assert corpus_pipeline.run(spark, empty).isEmpty()


def test_licenses():
    auto = licenses.Automaton((("x", "grant [[to any]] person {{2}} copy [[now [[and]]]] ok"),))
    run = lambda t: bool(auto.run(t.encode().split(), 0))
    assert run("grant person a copy ok") and run("grant to any person a b copy now and ok z")
    assert not run("grant to person a copy ok") and not run("grant person copy ok") and not run("grant person a b c copy ok")


def test_license_places(spark):
    text = "Apache License, VERSION 2! under the MIT-license under the mit license; CC BY-NC 4.0 licensed under cc by nc"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (22, 5, 0, 19)
    assert r["base_labels"] == "apache-2,cc-by-nc,mit" and r["labels"] == r["base_labels"] and 0 < r["score"] < 1


def test_toxicity_learns_from_parts_of_words():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        words = rng.choices(vocab, k=30)
        if i % 3 == 0:
            words[5:7] = ["qwizzle" + rng.choice(vocab), "xyzzle"]
        found = [toxicity.grams([w])[0] for w in words]
        w = np.bincount(np.concatenate(found), np.concatenate([np.full(len(x), 1 / len(x) / 30) for x in found]), toxicity.BUCKETS)
        at = np.flatnonzero(w)
        rows.append((int(i % 3 == 0), at.astype(np.uint16).tobytes(), w[at].astype(np.float32).tobytes()))
    model = toxicity.train(rows)
    usual = model.scores([w.encode() for w in vocab]).max()
    assert (model.scores([b"qwizzled", b"xyzzles"]) > usual).all()


def _plain_grams(word):
    marked = f"<{word}>"
    parts = {marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)} | {marked}
    return sorted({zlib.crc32(p.encode()) % toxicity.BUCKETS for p in parts})


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=12), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_toxicity_grams_of_many_words(words):
    buckets, ends = toxicity.grams(words)
    assert [x.tolist() for x in np.split(buckets, ends[:-1])] == [_plain_grams(w) for w in words]


def _plain_bag(text):
    words = toxicity.tokens((text or "").encode())
    weight = {}
    for w in words:
        for b in _plain_grams(w):
            weight[b] = weight.get(b, 0.0) + 1 / len(_plain_grams(w)) / len(words)
    return weight


def test_toxicity_against_plain_loops(spark):
    """Fit and score of 50 documents: n-grams, bags, softmax and gradients by loops over words and buckets."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 25)) + ["v1le"] * (i % 3 == 0))) for i in range(48)] + [(48, None), (49, "!!")]
    labels = [(i, int(i % 3 == 0)) for i in range(50)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")
    model = toxicity.fit(frame.repartition(7), marks, F.lit(True))
    rows = sorted((y, np.array(sorted(bag), np.uint16).tobytes(), np.array([bag[b] for b in sorted(bag)], np.float32).tobytes()) for (_, t), (_, y) in zip(docs, labels, strict=True) for bag in [_plain_bag(t)])
    want = _plain_train(rows)
    odds = toxicity.PRIOR * np.log(17 / 33)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame.repartition(3), model).collect()}
    for doc, text in docs:
        bag = _plain_bag(text)
        logit = want.bias + odds + sum(want.grams[b] * w for b, w in bag.items())
        assert abs(got[doc] - 1 / (1 + np.exp(-logit))) < 1e-3, doc
    again = {r["doc_id"]: r["score"] for r in toxicity.score(frame.coalesce(1), model).collect()}
    assert again == got


def _plain_train(rows, dim=8, steps=400, batch=64, rate=1.0, calm=1e-8, seed=7):
    """The same steps with one loop over documents, buckets and coordinates each, in double precision."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (toxicity.BUCKETS, dim)).astype(np.float32).astype(float)
    out, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32).astype(float), np.zeros(2)
    sums, sum_out, sum_bias = {}, np.full((dim, 2), 1e-2), np.full(2, 1e-2)
    y = [r[0] for r in rows]
    bags = [list(zip(np.frombuffer(a, np.uint16).tolist(), np.frombuffer(w, np.float32).tolist(), strict=True)) for _, a, w in rows]
    epochs = max(5, -(-steps * batch // len(rows)))
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            pick = order[start : start + batch]
            grads, d_out, d_bias = {}, np.zeros((dim, 2)), np.zeros(2)
            for i in pick:
                vec = sum((emb[b] * w for b, w in bags[i]), np.zeros(dim))
                p = np.exp(vec @ out + bias - (vec @ out + bias).max())
                p /= p.sum()
                p[y[i]] -= 1
                p *= 0.5 / (y.count(y[i]) / len(y)) / len(pick)
                d_out, d_bias = d_out + np.outer(vec, p), d_bias + p
                for b, w in bags[i]:
                    grads[b] = grads.get(b, 0) + out @ p * w
            for b, g in grads.items():
                sums[b] = sums.get(b, calm) + g**2
                emb[b] = emb[b] - step * g / np.sqrt(sums[b])
            sum_out, sum_bias = sum_out + d_out**2, sum_bias + d_bias**2
            out, bias = out - step * d_out / np.sqrt(sum_out), bias - step * d_bias / np.sqrt(sum_bias)
    side = out[:, 1] - out[:, 0]
    return toxicity.Model(emb @ side, float(bias[1] - bias[0]))


def test_toxicity_never_reads_other_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} filler text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    learn = F.col("doc_id") % 3 != 0
    turned = labels.withColumn("y", F.when(learn, F.col("y")).otherwise(1 - F.col("y")))
    a, b = (toxicity.fit(docs, x, learn) for x in (labels, turned))
    assert a.bias == b.bias and (a.grams == b.grams).all()


def test_url_rules(spark):
    pages = [
        (1, "http://www.Example.com/en/x?y=://z"), (2, "https://a.example.com/en/"), (3, "example.com/en/"), (4, None), (5, "x://net/es/1#/"),
        (6, "http://m.net/fr"), (7, "http://example.com"), (8, "http://notexample.com.evil/en/"), (9, "a\n://b.net/fr/\nq"), (9, "a\n://b.net/fr/\nq"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    want = [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "net", "/es/1", "net/es/", "block"), (6, "m.net", "/fr", None, "allow"), (7, "example.com", "", None, "allow"), (8, "notexample.com.evil", "/en/", None, "allow"),
        (9, "b.net", "/fr/\nq", "net/fr/", "block"), (9, "b.net", "/fr/\nq", "net/fr/", "block"),
    ]
    rules = catalog.RULES
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == want
    assert sorted(map(tuple, urls.judge(df, rules, most=1).collect())) == want  # every rule a range of its own
    assert sorted(map(tuple, urls.judge(df, []).collect())) == sorted((a, b, c, None, "allow") for a, b, c, _, _ in want)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_url_rules_given_twice_and_long_addresses(spark, most):
    """The last of equal rules holds, however the array is cut; a very long address is judged whole."""
    rules = [("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("b.com", "/" + "y" * 30_000, "block"), ("b.com", "/", "allow"), ("a.com", "/x\nz", "block")]
    pages = [(1, "http://a.com/xyz"), (2, "http://b.com/" + "y" * 100_000), (3, "http://" + "s." * 20_000 + "a.com/x"), (4, "http://a.com/x\nzz")]
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules, default="none", most=most).collect()}
    assert got == {1: ("allow", "a.com/x"), 2: ("block", "b.com/" + "y" * 30_000), 3: ("allow", "a.com/x"), 4: ("block", "a.com/x\nz")}


def test_colliding_digests_are_confirmed():
    (index,) = urls.digest_ranges([("a.com", "/", "block"), ("b.com", "/", "allow"), ("c.com", "/x", "block")], digest=lambda k: len(k) % 2)
    probe = lambda h, p: [index.full(j) for j in index.probe(index.candidates(h, p)) if j >= 0]
    assert probe("a.com", "/z") == [b"a.com\n/"] and probe("d.com", "/x") == [] and probe("w.c.com", "/xy") == [b"c.com\n/x"]
    assert urls.digest_ranges([]) == []


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.read_model(catalog.MODEL))


def _best(p, text):
    """Score of the best segmentation by plain dynamic programming."""
    scores = [0.0]
    flat = {}

    def collect(node, tail):
        for c, (score, i, before) in node.items():
            if i >= 0:
                flat[c + tail] = (score, i)
            collect(before, c + tail)

    if not hasattr(p, "flat"):
        collect(p.ends, "")
        p.flat = flat
    for end in range(1, len(text) + 1):
        best = [scores[s] + p.flat[text[s:end]][0] for s in range(max(0, end - p.longest), end) if text[s:end] in p.flat]
        if text[end - 1] not in p.flat:
            best.append(scores[-1] + p.fallback)
        scores.append(max(best))
    return scores[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abe the\u2581in  é中\u0301\U0001f600ingtion"), max_size=90))
def test_streaming_viterbi_is_best_and_exact(text):
    p = pieces.load(pieces.read_model(catalog.MODEL))
    ids = np.frombuffer(p.encode(text.encode()), np.int32).tolist()
    assert p.decode(ids) == text.encode()
    run = pieces.MARK + text.replace(" ", pieces.MARK)
    stream = pieces.Stream(p)
    stream.push(run)
    out = stream.finish()
    score = {i: s for s, i in ((v[0], v[1]) for v in _flat(p).values())}
    spelled = sum(score[i] for i in out if i in score) + p.fallback * sum(c not in _flat(p) for c in run)
    assert abs(spelled - _best(p, run)) < 1e-3


def _flat(p):
    _best(p, "")
    return p.flat


def test_window_is_bounded(model):
    stream = pieces.Stream(model)
    text = "".join(random.Random(3).choices("abcdefghinorst\u2581", k=40_000))
    stream.push(text)
    assert stream.widest < 40 * model.longest and len(stream.text) < 40 * model.longest
    assert model.decode([model.known and 0] and stream.finish()) == text.replace("\u2581", " ").encode()[1:]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abe the\u2581in  \u00e9\U0001f600ingtion"), max_size=150), max_size=6))
def test_runs_segmented_together_are_as_alone(texts):
    """Boundaries shared with the run before, texts in parts, lists in parts: the same ids as run by run."""
    p = pieces.load(pieces.read_model(catalog.MODEL))
    few, known = common.Cached(p.known.compute, 12), p.known
    given = [None if t is None else t.encode() for t in texts]
    alone = [None if t is None else b"".join(b"".join(p.known.compute(r) for r in q) if q is not None else np.array(p.char_bytes(pieces.MARK), np.int32).tobytes() for q in p.runs(t)) for t in given]
    p.known = few
    try:
        assert p.encode_all(given) == alone
    finally:
        p.known = known


def test_no_short_run_is_segmented_alone(spark, monkeypatch):
    p = pieces.Pieces(pieces.read_model(catalog.MODEL))
    monkeypatch.setattr(p, "segment", lambda run: pytest.fail(run))
    monkeypatch.setattr(pieces, "LISTED", 8)
    monkeypatch.setattr(pieces, "TAKEN", 2)
    text = b"one onetwo onetwothree  two onethr one"
    assert p.decode(np.frombuffer(p.encode_all([text, None, b""])[0], np.int32).tolist()) == text


def test_invalid_utf8_returns(model):
    raw = b"\xff\xfe caf\xc3 ok"
    assert model.decode(np.frombuffer(model.encode(raw), np.int32).tolist()) == raw


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.3, (400, 8)).astype(np.float32)
    vectors[100:250] = vectors[50]  # a large group of ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.1, None] + [0.0] * 6), (1100, [float("nan")] + [0.0] * 7), (1150, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (1200, [0.5] * 3), (1203, [0.25] * 3), (7, vectors[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).repartition(5)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(vectors.astype(float) * 256).astype(np.int64)
    want = {q: sorted(((i, int(whole[q] @ whole[i])) for i in range(400) if i != q), key=lambda x: (-x[1], x[0]))[:5] for q in range(0, 400, 50)}
    assert got == want | {1200: [(1203, 3 * 128 * 64)]}


def test_top_k_of_large_components(spark):
    """Components at and beyond every limit, as queries and as candidates: products as Python integers."""
    rng = np.random.default_rng(6)
    sizes = [0.3, 4095.99, 4096.0, 65_536.0, 70_000.0, 1e9, 1e15, -1e20, 1e30]
    rows = [(i, [float(sizes[i % 9] * rng.choice([1, -1]) * rng.uniform(0.5, 1)), float(rng.normal())]) for i in range(120)]
    rows += [(150, [70000.0, 1.0]), (151, [-1e20, 1.0]), (152, [1e300, 0.0]), (200, [1e308, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(c) * 256 if abs(c) > 1e300 else int(np.floor(256 * c)) for c in v] for i, v in rows}
    whole[200][0] = int(np.finfo(float).max)
    fit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    want = {q: [fit(s) for s in sorted((sum(a * b for a, b in zip(whole[q], whole[i], strict=True)) for i in whole if i != q), reverse=True)[:5]] for q in whole if q % 50 == 0}
    assert got == want


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(0)
    rows = rng.integers(-128, 128, (4096, 64)).astype(np.int32)
    _, read = topk.search_block(rows[:20], np.arange(20), np.arange(4096), rows >> topk.SHIFT, rows, 5)
    assert read < 20 * 4096 / 4


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_runs_over_range_borders(spark, keep_first):
    """One line in a third of all rows, frequent and rare ones, in many ranges."""
    rng = random.Random(4)
    docs = [(d, "\n".join(rng.choice(["Hot ", " hot", f"k{rng.randint(0, 40)}", f"u{d}", ""]) for _ in range(rng.randint(0, 6)))) for d in range(300)]
    docs += [(None, "hot\nz")] + docs[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit(0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {(r["doc_id"], r["before"]): r["text"] for r in lines.apply(df.withColumn("before", F.col("text")), lines.bitmaps(df, 10, 1, keep_first)).select("rest.doc_id", "rest.before", "text").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    uses = {}
    for d, t in set(docs):
        for i, x in enumerate(t.split("\n")):
            if x.strip():
                uses.setdefault(x.strip().lower(), []).append((d, i))
    for (d, before), text in got.items():
        if d is None:
            continue
        kept = []
        for i, x in enumerate(before.split("\n")):
            own = uses.get(x.strip().lower(), [])
            many = len({k for k, _ in own}) >= 10
            first = min(((k, j) for k, j in own if k is not None), default=None) == (d, i)
            if not many or (keep_first and first and "hot" != x.strip().lower()) or (keep_first and first):
                kept.append(x)
        if not (keep_first and "hot" in before.lower()):  # the row without id may come first for that line
            assert text == "\n".join(kept), (d, before)


def test_chat(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "a </turn>\n### Assistant: \\"), (1, 2, "assistant", "\\</turn> \\\\### ####"), (2, 5, "user", None), (2, 5, "assistant", ""),
        (3, 0, "assistant", "x"), (3, 1, "tool: ~\\\n", "y"), (None, 0, None, "z"), (None, None, "user", "w"), (4, 1, "User", "q"), (4, 2, "User", "q"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("seq", F.lit(1))
    formatted = chat.segments(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    parts = {}
    for r in formatted.collect():
        parts[r["conv_id"]] = parts.get(r["conv_id"], "") + r["segment"]
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join((t[3] or "") for t in own if t[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["formatted_chars"] == len(parts[c])
        assert r["valid"] == (c == 1)


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("\\#</turn>~: \nA"), max_size=30), st.text(st.sampled_from("\\#:~<\nuser"), max_size=8))
def test_turns_return(text, role):
    t = chat.Template()
    assert t.turn(t.opening.format(t.show(role)) + t.escape(text) + t.closing) == (role, text)


def test_templates_with_other_values(spark):
    item = "If Anna buys 12 apples at 3 dollars each and Anna gives Boris 4 of them, how much did Anna pay per apple that is left?"
    docs = [
        (1, "Intro. " + item + " The end."),
        (2, "Some words. " + item.replace("Anna", "Clara").replace("12", "96").replace("dollars", "euros").replace("Boris", "Dan")),
        (3, "Some words. " + item.replace("Anna", "Clara", 1).replace("Anna gives", "Peter gives")),  # two values for one slot
        (4, item.lower()),
        (5, "If Anna buys 12 apples at noon"),
        (6, item.upper()),
        (None, item),
    ]
    bench = [(10, item), (11, None), (12, "what is seven times six"), (13, "too short"), (10, item)]
    docs.append((7, "So. What is seven times six? he asked"))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("window", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) >= {(1, 10), (2, 10), (3, 10), (7, 12)} and not any(k[0] in (5, None) for k in got)
    assert got[1, 10]["verbatim"] and not got[2, 10]["verbatim"] and got[2, 10]["n_slots"] >= 5


def test_short_and_placeholder_rich_items(spark):
    """Items of a few words; numbers and names that outnumber the plain words, with other values; a list of numbers alone is no copy."""
    bench = [(1, "What is seven squared?"), (2, "Sum the numbers 12 15 18 21 24 27 30 33 36 39 and 42, then divide the sum by 11."), (3, "After lunch Mary and Tom drove 40 miles to Paris, 50 miles to Rome and 60 miles to Berlin with Anna.")]
    docs = [
        (1, "He asked me: what is seven squared? I knew."), (2, "What is seven minus two?"),
        (3, "Question. Sum the numbers 2 5 8 1 4 7 0 3 6 9 and 22, then divide the sum by 13. Good luck."),
        (4, "Lists: " + " ".join(map(str, range(500)))), (5, "After lunch Bob and Tim drove 41 miles to London, 51 miles to Lisbon and 61 miles to Vienna with Clara."),
        (6, "Sum the numbers 7 7 7 7 7 7 7 7 7 7 and 7, then divide the sum by 7."),
    ]
    assert set(_found(spark, docs, bench)) == {(1, 1), (3, 2), (5, 3), (6, 2)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b, shortest=5).collect()} == {(3, 2), (5, 3), (6, 2)}


def test_rows_of_one_document_are_searched_apart(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    words = item.split()
    halves = [(1, " ".join(words[:11])), (1, " ".join("x" * 11) + " " + " ".join(words[11:])), (2, item), (2, "clean"), (2, item)]
    assert set(_found(spark, halves, [(9, item)])) == {(2, 9)}


def _found(spark, docs, bench):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}


def test_edited_copies_are_cut_into_stretches(spark):
    """One of several places of a value edited: what is left of the copy on either side is judged by itself."""
    item = "If Anna buys 12 apples at 3 dollars each and Anna gives Boris 4 of them, how much did Anna pay per apple that is left?"
    docs = [
        (1, "Some words. " + item.replace("Anna gives", "Peter gives")),  # 15 words behind the edit
        (2, "Some words. " + item.replace("much did Anna", "much did Peter")),  # 18 before it
        (4, "Some words. " + item.replace("Anna", "Clara").replace("much did Clara", "much did Peter")),  # other names, 18 words
    ]
    other = "Look at the ball that Anna threw to the dog of Anna and that came back to Anna by the gate of Anna at noon."
    for name in ("Bea", "Cleo", "Dora", "Emma"):
        changed = (docs[-1][1] if docs[-1][0] == 3 else other).replace("Anna", name, 1)
        docs = [d for d in docs if d[0] != 3] + [(3, changed)]  # stretches of fewer than 13 words
    got = _found(spark, docs, [(10, item), (11, other)])
    assert set(got) == {(1, 10), (2, 10), (4, 10)}
    assert (got[1, 10]["start"], got[1, 10]["n_windows"]) == (4, 9)  # from behind the first name to before the last
    assert (got[2, 10]["start"], got[2, 10]["verbatim"]) == (2, True) and got[2, 10]["n_windows"] >= 11 and not got[4, 10]["verbatim"]


def test_items_of_numbers_and_names(spark):
    """Items with few plain words are found by their words."""
    numbers = "Sum the numbers 12 15 18 21 24 27 30 33 36 39 and 42, then divide the sum by 11."
    cities = "Which of the cities Paris, Rome, Berlin, Madrid, Vienna, Oslo or Lisbon lies furthest north?"
    short = "Add 3 4 5 6 7 8"
    docs = [
        (1, "Before. " + numbers + " After."),
        (2, "Before. " + cities + " After."),
        (3, "Before: numbers 12 15 18 21 24 27 30 33 36 39 and 42, but then"),  # 13 words
        (4, "Before: numbers 12 15 18 21 24 27 30 33 36 39 and, but then"),  # 12 words
        (5, "Before. " + short + " 9"),
        (6, "Before. Add 3 4 5 6 7 9"),
    ]
    got = _found(spark, docs, [(10, numbers), (11, cities), (12, short)])
    assert set(got) == {(1, 10), (2, 11), (3, 10), (5, 12)}
    assert all(r["verbatim"] for r in got.values()) and got[3, 10]["start"] == 1 and got[3, 10]["n_windows"] == 6


def test_copies_in_other_letters_and_lines(spark):
    item = "If Anna buys 12 apples at 3 dollars each and Anna gives Boris 4 of them, how much did Anna pay per apple that is left?"
    docs = [
        (1, item),
        (4, item.lower()),
        (6, item.upper()),
        (7, "Words.\n" + item.replace(" Anna", "\nAnna").replace(" Boris", ":\n\nBoris")),  # names at the start of lines
        (8, "So asked: if Anna buys 12 apples at 3 dollars each and Anna gives. Boris"),  # 14 words
        (9, "So asked: if Anna buys 12 apples at 3 dollars each and anna went"),  # 12 words
    ]
    got = _found(spark, docs, [(10, item)])
    assert set(got) == {(d, 10) for d in (1, 4, 6, 7, 8)}
    assert all(got[d, 10][c] == got[1, 10][c] for d in (4, 6, 7) for c in ("n_windows", "n_slots", "verbatim"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    edges = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")
    assert {r["node"]: r["root"] for r in common.components(edges).collect()} == {x: find(x) for x in root}


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Chains, a star of near copies and copies, with cells so small that buckets are cut."""
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "DENSE", 8)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base = [word() for _ in range(120)]
    docs = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            own[rng.randrange(120)] = word()
        docs.append(" ".join(own))
    chain = [word() for _ in range(100)]
    for i in range(10):
        docs.append(" ".join(chain[3 * i : 3 * i + 70]))
    docs += ["a b c", "A  b\tc", "a b c d", "", " ", "x", "é x", "É x"]
    sets = []
    for t in docs:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for percent in (85, 60):
        root = list(range(len(docs)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(docs)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("rep", F.lit(1))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, percent).collect()}
        assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(docs))}


def test_members_of_the_largest_part_do_not_meet(spark, monkeypatch):
    """One bucket of two parts and some strays, small chunks: all pairs of different parts whose sets link, no member of the large part with another."""
    monkeypatch.setattr(minhash, "CELL", 4)
    count, base = 48, list(range(100, 140))
    sets = {i: np.array(sorted([*base, 1000 + i, 2000 + i]), np.uint64) for i in range(40)} | {i: np.array([i, 7], np.uint64) for i in range(90, 97)}
    part = {i: 0 for i in range(30)} | {i: 30 for i in range(30, 35)} | {i: i for i in [*range(35, 40), *range(90, 97)]}
    strays = sum(p != 0 for p in part.values())
    mixed = spark.createDataFrame([(1, i, part[i], len(sets), strays, part[i] != 0) for i in sets], "bucket long, rep long, part long, n long, strays long, stray boolean")
    own = spark.createDataFrame([(i, bytearray(minhash.signature(x, count).tobytes()), bytearray(x.tobytes())) for i, x in sets.items()], "rep long, sig binary, x binary")
    want = set()
    for a in sets:
        for b in sets:
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if a < b and part[a] != part[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert len(want) > 300
    got = minhash.cells(mixed, own, count, 85, 1e-9)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    alone = mixed.where("part = 0 OR rep = 90").withColumns({"strays": F.lit(1).cast("long"), "n": F.lit(31).cast("long")})
    assert minhash.cells(alone, own, count, 85, 1e-9).count() == 0


def test_pruning_keeps_what_the_posterior_allows():
    steps = dict(minhash.least_matches(240, 24, 85, 1e-9))
    assert all(0 < m < 0.85 * n for n, m in steps.items()) and steps[240] > 0.5 * 240


def test_isotonic():
    ones, all_ = np.array([0, 3, 1, 0, 4.0]), np.array([2, 4, 4, 0, 4.0])
    assert np.allclose(quality.isotonic(ones, all_), [0, 0.5, 0.5, 0.5, 1])


def test_quality_agrees_with_whole_matrices(spark):
    """Ridge as one least-squares problem over all rows, isotonic scores by the min-max formula over all intervals."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["data", "River,", "THE", "sun.", "12", "é", "!!", "x\ny"]) for _ in range(rng.randrange(60))) for _ in range(250)] + ["", None]
    y = [float(rng.random() < 0.2 + 0.6 * ("THE" in (t or "")[:30])) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, y int")
    stats = quality.measure(docs)
    model = quality.fit(stats, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(stats, model).collect()}

    x = np.array([quality.statistics((t or "").encode()) for t in texts])
    learn = np.array([i % 5 != 0 for i in range(len(texts))])
    target = np.array(y)[learn]
    spread = x[learn].std(0)
    spread[spread < 1e-5] = 1
    draw = np.random.default_rng(11)
    turn, phase = draw.normal(0, 1 / 3, (x.shape[1], quality.FEATURES)), draw.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.sqrt(2 / quality.FEATURES) * np.cos((x - x[learn].mean(0)) / spread @ turn + phase)
    z = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.diag([np.sqrt(1e-3 * learn.sum())] * quality.FEATURES + [0.0])
    weights = np.linalg.lstsq(np.vstack([z[learn], penalty]), np.concatenate([target, np.zeros(len(penalty))]), rcond=None)[0]
    raw = z @ weights
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    place = np.clip(np.floor((raw + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1).astype(int)
    used = sorted(set(place[learn]))
    ones, all_ = (np.array([w[place[learn] == b].sum() for b in used]) for w in (target, np.ones(len(target))))
    share = [[ones[i : j + 1].sum() / all_[i : j + 1].sum() if i <= j else None for j in range(len(used))] for i in range(len(used))]
    fitted = [max(min(share[i][j] for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    want = [fitted[max(0, np.searchsorted(used, b, side="right") - 1)] for b in place]
    edge = np.abs((raw + 0.5) / 2 * quality.BINS - np.round((raw + 0.5) / 2 * quality.BINS)) < 1e-3
    assert edge.sum() < 5 and np.allclose(np.array([got[i] for i in range(len(texts))])[~edge], np.array(want)[~edge], atol=1e-9)


def test_quality_never_reads_other_labels(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9) + "!" * (i % 4)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    learn = F.col("doc_id") % 3 != 0
    turned = labels.withColumn("y", F.when(learn, F.col("y")).otherwise(1 - F.col("y")))
    stats = quality.measure(docs)
    a, b = (quality.fit(stats, x, learn) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.calibrated, b.calibrated)


def test_full_sets_are_opened_a_slice_at_a_time(monkeypatch):
    """Of a batch of pairs with large sets, a few are compared at once, and the task gives back what it freed."""
    freed = []
    monkeypatch.setattr("gridloom.llm.common.SLICE_BYTES", 1000)
    monkeypatch.setattr(minhash, "give_back", lambda: freed.append(1))
    x, y = (np.arange(s, s + 40, dtype=np.uint64).tobytes() for s in (0, 2))
    rows = [(0, i, x, y if i % 2 else x[:80]) for i in range(1, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "x", "y"])
    found = list(minhash.confirmed(iter([batch]), 80))
    assert [p for b in found for p in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(0, i) for i in range(1, 12, 2)]
    assert len(found) == 4 and freed == [1]
