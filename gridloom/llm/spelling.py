"""Spelling variants grouped with a bit-sliced position index.

Words are counted over whole texts. Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Near words share either their first or their last half, so a word meets others in buckets: for a shorter length
``l`` the first ``l // 2`` letters, or the last ``l - l // 2`` (those words are written backwards, so the shared part
comes first). A bucket of length l holds words of l and l + 1 letters.

A task packs buckets of one kind into blocks of up to BLOCK words. Per (position, letter) a bitset tells which words of the
block have that letter there. For many query words at once, 64 block words at a time, recurrences over the positions track
the set that agrees so far (no error) and the sets that agree but for one replaced, inserted or deleted letter; for the
last two, bitsets of the position before or after are met. Words in a block stand in order of falling frequency, so the
lowest bit of a result is the most frequent near word. Larger buckets are cut into blocks by hash; all words of the
bucket are then streamed past each of them. Each block gives out one row a query word, never its pairs.

Null and empty texts have no words; rows without doc_id count with an empty id; every row counts, repeated ones too; ties
in frequency go to the smallest word in code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices, stage, texts

#: Letters of words: ASCII and Latin-1 letters (with the two signs between them).
RUN = "a-zÀ-ÿ"
#: Words of a block; query words that are looked up at once.
BLOCK, QUERIES = 8192, 1024
#: One run in so many loses a letter.
DAMAGE = 199
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def counted(docs: DataFrame, least_letters: int, least_count: int) -> DataFrame:
    """word and n: occurrences of words long and frequent enough, over all documents."""
    runs = re.compile(f"[{RUN}]{{{least_letters},}}")

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                total: Counter = Counter()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    # bytes.lower changes A-Z alone
                    for run, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                        h = zlib.crc32(run.encode(), head)
                        if h % DAMAGE == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        total[run] += n
                words = [w for w in total if len(w) >= least_letters]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Index:
    """Bitsets per (position, letter) over words of l and l + 1 letters, in order of falling frequency, ties as the words read forwards."""

    def __init__(self, words: list[str], counts: list[int], l: int, backwards: bool):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i][::-1] if backwards else words[i]))
        self.words, self.counts = [words[i] for i in order], [counts[i] for i in order]
        self.l, self.backwards, self.width = l, backwards, -(-len(words) // 64)
        letters = codes(self.words, l + 1)
        self.letters = np.unique(letters)
        # One more row, of no word, for letters that no word has.
        self.sets = np.stack([self._bits(np.vstack([letters[:, p] == c for c in self.letters] + [np.zeros(len(words), bool)])) for p in range(l + 1)])
        short = np.array([len(w) == l for w in self.words])
        self.short, self.long = self._bits(short[None])[0], self._bits(~short[None])[0]

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        full = np.zeros((len(rows), self.width * 64), bool)
        full[:, : rows.shape[1]] = rows
        return np.packbits(full, axis=1, bitorder="little").view("<u8")

    def _at(self, queries: np.ndarray) -> np.ndarray:
        """Row of each query letter in ``sets``."""
        at = np.minimum(np.searchsorted(self.letters, queries), len(self.letters) - 1)
        return np.where(self.letters[at] == queries, at, len(self.letters))

    def near(self, queries: list[str], shared: int) -> np.ndarray:
        """Bitsets of the words near each query, which all have l or all l + 1 letters, that share its first ``shared`` letters.

        Of words written backwards, those that also share the first half are left out; they met there.
        """
        n = len(queries[0])
        at = self._at(codes(queries, n))
        same = np.broadcast_to(ONES, (len(queries), self.width))
        for i in range(shared):
            same = same & self.sets[i][at[:, i]]
        zero, other, nothing = same, same, np.zeros_like(same)
        if n == self.l:
            replaced, inserted = nothing, same
            for i in range(shared, n):
                here, ahead = self.sets[i][at[:, i]], self.sets[i + 1][at[:, i]]
                replaced = (replaced & here) | (zero & ~here)
                zero = zero & here
                inserted = (inserted & ahead) | zero
                other = other & ahead
            found = (replaced & self.short) | (inserted & self.long)
            return found & ~(other & self.long) if self.backwards else found
        deleted = same
        for i in range(shared + 1, n):
            behind = self.sets[i - 1][at[:, i]]
            zero = zero & self.sets[i - 1][at[:, i - 1]]
            deleted = (deleted & behind) | zero
            other = other & behind
        found = deleted & self.short
        return found & ~(other & self.short) if self.backwards else found


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, padded with zeros."""
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width)


def looked_up(index: Index, queries: list[str], shared: int):
    """Per query with near words in the block: its place, their number, the most frequent one's count and word."""
    for n in (index.l, index.l + 1):
        own = np.array([i for i, q in enumerate(queries) if len(q) == n], np.int64)
        for s in range(0, len(own), QUERIES):
            pick = own[s : s + QUERIES]
            found = index.near([queries[i] for i in pick], shared)
            hit = np.flatnonzero(found.any(1))
            if len(hit):
                found = found[hit]
                part = (found != 0).argmax(1)
                low = found[np.arange(len(hit)), part]
                first = part * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
                for i, count, f in zip(pick[hit], np.bitwise_count(found).sum(1), first, strict=True):
                    yield int(i), int(count), index.counts[f], index.words[f]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, number of near words in a block of a bucket, and the best of them as (best_n, best)."""
    size = F.length("word")
    kinds = []
    for less in (0, 1):
        l = size - less
        half = F.floor(l / 2).cast("int")
        kinds += [F.struct(l.alias("l"), F.lit(False).alias("back"), F.col("word").alias("w"), half.alias("h"))]
        kinds += [F.struct(l.alias("l"), F.lit(True).alias("back"), F.reverse("word").alias("w"), (l - half).alias("h"))]
    met = words.select("n", F.inline(F.array(*kinds))).withColumn("head", F.expr("substring(w, 1, h)"))
    bucket = ["l", "back", "head"]
    sizes = stage(met.groupBy(*bucket).agg(F.count("*").alias("size"), F.count(F.expr("CASE WHEN length(w) = l THEN 1 END")).alias("short")).where("size > 1 AND short > 0"), "buckets")
    parts = F.ceil(F.col("size") / block)
    dealt = met.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("w"), parts)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("l", "back", "head", "h", "part", (F.col("own") != F.col("part")).alias("visits"), "w", "n")
    dealt = dealt.repartition("l", "back", "head", "part").sortWithinPartitions("l", "back", "head", "part", "visits")

    def run(batches):
        kind, key, base, counts, asked, index = None, None, [], [], [], None

        def look():
            nonlocal index
            if index is None and base:
                index = Index(base, counts, kind[0], kind[1])
            rows = list(looked_up(index, asked, kind[2])) if base else []
            turn = (lambda w: w[::-1]) if kind[1] else (lambda w: w)
            columns = [turn(asked[i]) for i, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [turn(r[3]) for r in rows]
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

        for batch in batches:
            for l, back, head, h, part, visits, w, n in zip(*(batch.column(c).to_pylist() for c in ("l", "back", "head", "h", "part", "visits", "w", "n")), strict=True):
                if (l, back, head, part) != key:
                    key = (l, back, head, part)
                    # Blocks of one bucket are never packed together: their words meet as visitors.
                    if kind is not None and ((l, back, h) != kind or len(base) >= block or part):
                        if asked:
                            yield look()
                        base.clear()
                        counts.clear()
                        index = None
                    kind = (l, back, h)
                if not visits:
                    base.append(w)
                    counts.append(n)
                    index = None
                asked.append(w)
                if len(asked) >= 8 * block and visits:
                    yield look()
        if asked:
            yield look()

    return dealt.mapInArrow(run, "word string, near long, best_n long, best string")


def variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    The form is the near word of largest n, if that is at least ``factor`` times the word's own; the root is where the
    forms lead to. Counts grow by the factor with every step, so the paths are short; they are halved in each round.
    """
    words = stage(counted(docs, least_letters, least_count), "vocabulary")
    near = near_words(words, block).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top"))
    strong = -F.col("top.minus") >= factor * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", F.when(strong, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("top.minus")).alias("form_n")
    )
    formed = stage(formed, "forms")
    paths = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = stage(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        if paths.where("moved").isEmpty():
            break
        paths = paths.drop("moved")
    return formed.join(paths.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
