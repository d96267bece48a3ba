"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a maximal run of letters, marks and digits of the text in small letters (white space and punctuation cut it;
``@`` and ``$`` stay, they stand for letters in misspellings). It is the mean of the vectors of its character n-grams
with ``<`` and ``>`` at its ends, hashed into buckets, so unseen misspellings share vectors with the words they imitate.
A document is the mean of its words' vectors; the score of a text of any length takes one pass over its words.

Only labels of rows that ``learn`` selects are read. The fit takes at most ``most`` labelled documents a class, those
with the smallest hash of doc_id; this bound is a parameter and the only limit. Executors turn their whole texts into
n-gram counts; the driver gets at most ``2 * most`` rows of at most BUCKETS counts each.

Null and empty texts score the class prior of the fit; no labels at all: every score is 0. Repeated rows score alike;
null labels are skipped, a document with several labels counts as toxic if any says so; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_small, over_texts, stage

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
#: Share of the classes' log odds that the score takes into account; 1 finds fewer toxic texts, 0 rejects more clean ones.
PRIOR = 0.35
#: Bytes of text hashed at once: a slice costs about 40 times its size while its n-grams are sorted.
SLICE = 2 << 20
WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is a multiple of 5; a null id counts as the text of nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _table() -> np.ndarray:
    """CRC-32 of every byte: eight shifts by the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(0xEDB88320), value >> 1)
    return value


TABLE = _table()


def _append(crc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Running CRC-32 of many texts after one more code point each, as UTF-8."""
    size = 1 + (code >= 0x80).astype(np.uint8) + (code >= 0x800) + (code >= 0x10000)
    lead = code if not len(code) or size.max() == 1 else np.choose(size - 1, [code, 0xC0 | code >> 6, 0xE0 | code >> 12, 0xF0 | code >> 18])
    crc = TABLE[(crc ^ lead) & 255] ^ crc >> 8
    for k in (2, 3, 4):
        more = np.flatnonzero(size >= k)
        if not len(more):
            break
        rest = 0x80 | code[more] >> (6 * (size[more] - k)) & 0x3F
        crc[more] = TABLE[(crc[more] ^ rest) & 255] ^ crc[more] >> 8
    return crc


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of many words and of the whole words, distinct and in order a word; and where each word's end.

    All n-grams of one length are hashed at once, each length going on from the one before.
    """
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(code))
    found = [np.arange(len(words)) * BUCKETS + np.fromiter((zlib.crc32(m.encode()) % BUCKETS for m in marked), np.int64, len(marked))]
    crc = np.full(len(code), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        crc = _append(crc[: max(0, len(code) - n + 1)], code[n - 1 :])
        if n in GRAMS:
            at = np.flatnonzero(left[: len(crc)] >= n)
            found.append(owner[at] * BUCKETS + (~crc[at] % BUCKETS).astype(np.int64))
    both = np.sort(np.concatenate(found))
    both = both[np.diff(both, prepend=-1) > 0]
    return both % BUCKETS, np.searchsorted(both, np.arange(1, len(words) + 1) * BUCKETS)


class Bag:
    """Tokens of a slice of texts: its distinct words, and each text's words as places among them."""

    def __init__(self, texts: list[bytes | None]):
        found = [tokens(t or b"") for t in texts]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        self.words = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, int(self.sizes.sum()))
        self.buckets, self.ends = grams(list(place))
        self.starts = np.append(0, self.ends[:-1])[: len(self.ends)]


def tokens(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def bags(docs: DataFrame) -> DataFrame:
    """Each document as n-gram buckets with weights that sum to 1, and its number of words."""

    def work(part: pa.RecordBatch):
        bag, rows = Bag(part.column("text").cast(pa.binary()).to_pylist()), []
        size = bag.ends - bag.starts
        for words in np.split(bag.words, np.cumsum(bag.sizes)[:-1]):
            own = np.concatenate([bag.buckets[bag.starts[w] : bag.ends[w]] for w in words]) if len(words) else bag.buckets[:0]
            weight = np.bincount(own, np.repeat(1 / size[words] / max(1, len(words)), size[words]), BUCKETS)
            at = np.flatnonzero(weight)
            rows.append((at.astype(np.uint16).tobytes(), weight[at].astype(np.float32).tobytes()))
        return {"y": part.column("y"), "at": [r[0] for r in rows], "weight": [r[1] for r in rows]}

    return over_texts(docs.select("y", "text"), work, "y int, at binary, weight binary", SLICE)


@dataclass
class Model:
    """Logit of a bucket's n-gram, and of a document without words."""

    grams: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        bag = Bag(texts)
        size = bag.ends - bag.starts
        word = np.bincount(np.repeat(np.arange(len(size)), size), self.grams[bag.buckets], len(size)) / size
        text = np.bincount(np.repeat(np.arange(len(texts)), bag.sizes), word[bag.words], len(texts))
        logit = self.bias + text / np.maximum(bag.sizes, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(rows: list[tuple[int, bytes, bytes]], dim: int = 8, steps: int = 400, batch: int = 64, rate: float = 1.0, calm: float = 1e-8, seed: int = 7) -> Model:
    """Embeddings and softmax trained together with Adagrad on the bags; both classes weigh alike."""
    labels = np.array([r[0] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 40.0 if labels.any() else -40.0)
    at = [np.frombuffer(r[1], np.uint16) for r in rows]
    weight = [np.frombuffer(r[2], np.float32) for r in rows]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    out += rng.normal(0, 0.5, out.shape).astype(np.float32)
    g_emb, g_out, g_bias = np.full_like(emb, calm), np.full_like(out, 1e-2), np.full_like(bias, 1e-2)
    share = np.bincount(labels, minlength=2) / len(labels)
    epochs = max(5, -(-steps * batch // len(rows)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            sizes = [len(at[i]) for i in pick]
            cols, w = np.concatenate([at[i] for i in pick]), np.concatenate([weight[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            vec = np.empty((len(pick), dim), np.float32)
            part = emb[cols] * w[:, None]
            for d in range(dim):
                vec[:, d] = np.bincount(doc, part[:, d], len(pick))
            logit = vec @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= (0.5 / share[labels[pick]] / len(pick))[:, None]
            d_vec, d_out, d_bias = p @ out.T, vec.T @ p, p.sum(0)
            touched, inverse = np.unique(cols, return_inverse=True)
            grad = np.stack([np.bincount(inverse, d_vec[doc, d] * w, len(touched)) for d in range(dim)], 1).astype(np.float32)
            g_emb[touched] += grad**2
            emb[touched] -= step * grad / np.sqrt(g_emb[touched])
            g_out += d_out**2
            out -= step * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= step * d_bias / np.sqrt(g_bias)
    side = out[:, 1] - out[:, 0]
    return Model((emb @ side).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 2200) -> Model:
    """``labels`` has doc_id and ``y`` (0 or 1); rows where ``learn``, an expression over doc_id, holds are learnt from."""
    known = labels.where(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    chosen = stage(parts[0].union(parts[1]), "sample")
    rows = bags(join_small(docs.select("doc_id", "text"), chosen, "doc_id", "inner")).collect()
    rows = sorted((r["y"], bytes(r["at"]), bytes(r["weight"])) for r in rows)
    model = train(rows)
    # Trained as if both classes were as frequent; the bias takes back PRIOR of the true log odds.
    there = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if there.get(0) and there.get(1):
        model.bias += PRIOR * float(np.log(there[1] / there[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; the model is BUCKETS numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch):
        return {"doc_id": part.column("doc_id"), "score": shared.value.scores(part.column("text").cast(pa.binary()).to_pylist())}

    return over_texts(docs.select("doc_id", "text"), work, "doc_id long, score double", SLICE)
