"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, licenses, lines, metricjoin, minhash, pieces, quality, ranking, spelling, topk, toxicity, urls
from gridloom.llm.common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def _licenses_sql() -> str:
    """Phrases and templates as patterns over the words, each with one space around."""

    def pattern(markup: str) -> str:
        out = re.sub(r"\[\[\s*", "(", re.sub(r"\s*\]\]", ")?", re.sub(r"\{\{(\d+)\}\}", r"([^ ]+ ){1,\1}", markup)))
        out = re.sub(r"([^\s()\[\]{}?+^,]+)(?= |$|\))(?! \))", r"\1 ", out)
        return " " + re.sub(r" +", " ", out).replace(") ", ")").replace("? ", "?").replace("([^ ]+ )", "([^ ]+ )")

    known = [(label, phrase, len(phrase.split())) for phrase, label in licenses.BASE.items()]
    for label, markup in licenses.TEMPLATES:
        bare = re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", " ", markup)
        known.append((label, markup, len(bare.split())))
    tests = [(label, f"regexp_matches(s, '{pattern(markup)}')", m) for label, markup, m in known]
    labels = ", ".join(f"CASE WHEN {t} THEN '{label}' END" for label, t, _ in tests)
    most = ", ".join(f"CASE WHEN {t} THEN {m} ELSE 0 END" for _, t, m in tests)
    places = " || ".join(
        f"list_filter(range(len(w)), lambda i: w[i + 1] = '{p.split()[0]}' AND w[i + 1:i + {len(p.split())}] = {p.split()})" for p in licenses.BASE
    )
    base = ", ".join(f"CASE WHEN regexp_matches(s, ' {p} ') THEN '{label}' END" for p, label in licenses.BASE.items())

    def joined(cases: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',')"

    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w FROM documents),
e AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' s, {places} p FROM d)
SELECT doc_id, len(w)::BIGINT n_words, len(p)::BIGINT n_base, list_min(p)::BIGINT first_word, list_max(p)::BIGINT last_word,
  {joined(base)} base_labels, {joined(labels)} labels, greatest({most}) / (greatest({most}) + 4.0)::DOUBLE score FROM e"""


@query(_licenses_sql())
def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def _predicted(scores: DataFrame, least: float) -> DataFrame:
    hit = F.when(F.col("score") >= least, 1).otherwise(0)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", hit.alias("predicted"))


def _learn() -> Column:
    return ~toxicity.held_out(F.col("doc_id"))


@query()
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return _predicted(toxicity.score(docs, toxicity.fit(docs, labels, _learn())), 0.5)


def _urls_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH r(h, p, v) AS (VALUES {rules}),
a AS (SELECT row_number() OVER () i, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
m AS (SELECT i, max(struct_pack(n := length(h || p), k := length(h), rule := h || p, v := v)) b
  FROM a JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') verdict FROM a LEFT JOIN m USING (i)"""


@query(_urls_sql())
def op3_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query()
def op4_sentencepiece(spark, sf_dir, model_path: str = MODEL):
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(model_path))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5""")
def op5_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i, unnest(string_split(coalesce(text, ''), chr(10))) t FROM documents),
k AS (SELECT doc_id, i, t, trim({lowered('t')}, {SPACES}) k FROM l),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT n_lines, count(f.k)::BIGINT n_dropped,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY doc_id""")
def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lines.apply(docs, lines.bitmaps(docs, min_docs=10)).select("rest.doc_id", "n_lines", "n_dropped", "kept_sha256")


@query(r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g')) n,
  CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE length(regexp_replace(role, '([\\:#<\n])', '\\\1', 'g')) + 1 END r FROM c)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) loss_sha256,
  sum(n + r + 15)::BIGINT formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, t), '(system,)?user,assistant(,user,assistant)*') valid
FROM e GROUP BY conv_id""")
def op7_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.segments(turns.union(own)))


@query()
def op8_decontaminate(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({lowered('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a u, b v FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, doc_id FROM d),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) c FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.c component_id, d.doc_id = c.c kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = d.doc_id""")
def op9_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query()
def op10_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    stats = quality.stage(quality.measure(table(spark, sf_dir, "documents")), "statistics")
    return _predicted(quality.score(stats, quality.fit(stats, labels, _learn())), 0.3)


_BYTES = """flatten(list_transform(list_transform(string_split({0}, ''), lambda c: unicode(c)),
  lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END))"""


@query(f"""
WITH RECURSIVE polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) t),
r AS (SELECT doc_id, run, count(*) n FROM (
  SELECT coalesce(doc_id::VARCHAR, '') doc_id, unnest(regexp_extract_all({lowered('text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce({_BYTES.format("doc_id || ':' || run")}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) h FROM r, polynomial),
w AS (SELECT word, sum(n)::BIGINT n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) less FROM (SELECT word, n, unnest(range(length(word))) i FROM w)),
e AS (SELECT DISTINCT a.word, b.word near, b.n m FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
k AS (SELECT word, count(*) n_near, min(struct_pack(a := -m, b := near)) best FROM e GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN -best.a >= 5 * n THEN best.b END form, CASE WHEN -best.a >= 5 * n THEN -best.a END::BIGINT form_n FROM w LEFT JOIN k USING (word)),
p AS (SELECT word, word root, 0 step FROM f UNION ALL SELECT p.word, f.form, step + 1 FROM p JOIN f ON p.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, last.root AS root, n, n_near, form_n FROM f JOIN (SELECT word, max(struct_pack(step := step, root := root)) "last" FROM p GROUP BY word) USING (word)""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT vec_id, vec_id FROM embeddings),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) c FROM r GROUP BY a),
n AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT n_links, c.c component_id, vec_id = c.c kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op12_embedding_dedup(spark, sf_dir):
    return metricjoin.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def _terms_sql(column: str) -> str:
    return f"regexp_extract_all({lowered(column)}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@query(f"""
WITH d AS (SELECT row_number() OVER () i, doc_id, {_terms_sql('text')} w FROM documents),
s AS (SELECT count(*) all_docs, sum(len(w))::BIGINT all_terms FROM d WHERE len(w) > 0),
f AS (SELECT i, any_value(doc_id) doc_id, any_value(n) n, term, count(*) tf FROM (SELECT i, doc_id, len(w) n, unnest(w) term FROM d) GROUP BY i, term),
q AS (SELECT item_id, term, count(*) c FROM (SELECT item_id, unnest({_terms_sql('text')}) term FROM benchmark) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT w FROM f, s GROUP BY term, all_docs),
t AS (SELECT q.item_id, f.i, any_value(f.doc_id) doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_docs) // all_terms)))))::BIGINT score
  FROM q JOIN f USING (term) JOIN g USING (term), s GROUP BY q.item_id, f.i),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER "rank", doc_id, score FROM t WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 20""")
def op13_ranked_search(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
