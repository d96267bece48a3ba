"""Benchmark decontamination by template windows, in DataFrame operations only.

Words become template tokens: numbers, units and names turn into typed placeholders, other words into small letters. Windows
of WINDOW template tokens of all texts meet those of the benchmark in a hash join. Hits of a document and an item that lie on
one diagonal (place in the text minus place in the item) form a run. It is cut into the longest stretches with consistent
slots: each value of the item stands for one value of the text wherever it occurs. A stretch is a passage if it holds enough
of the item. So exact passages are found, and questions asked again with other numbers or names.

A name is a word with one capital that does not start a sentence. Template windows without a plain word tell nothing and are
left out. Those with fewer plain words than placeholders count only where a stretch holds twice the windows of a passage, or
all that the item has, and three different slot values stand in it. PASSAGE words in a row, in small letters, are met as one window besides, whatever words they are; it stands for the
template windows that it holds. So copies in other letters, or with other marks or line ends before a name, are found too, and
a name or unit that only the item shows as one is a slot with its own value.
Null and empty texts hold nothing. Items of fewer than WINDOW tokens are one window of their own length; those of fewer than
``shortest``, which is 1 unless the caller wants otherwise, match nothing. Rows without doc_id or item_id cannot be reported
and are left alone. Rows of one doc_id with several texts are searched each by itself; a document is reported once an item,
with its best passage; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_small, stage

WINDOW = 8
#: Consecutive words of an item that make a passage; a shorter item has to be there as a whole.
PASSAGE = 13
#: Different slot values that a stretch with few plain words needs.
VALUES = 3
#: Spelled-out units and their signs (fixed values).
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds "
    "ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres percent cent cents dollar dollars euro euros degree degrees"
).split()
#: A word or number; a sentence mark before it belongs to the token, so that a capital behind it is no sign of a name.
TOKEN = r"(?:[.!?\n][^\p{L}\p{N}]{0,8}+)?(?:\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*)"
LEAD = r"^[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Tokens in order; the text's start counts as a sentence's start."""
    return F.regexp_extract_all(F.concat(F.lit("."), F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def plain(token: Column) -> Column:
    """The token without the sentence mark, in small letters."""
    return F.lower(F.when(token < "A", F.regexp_replace(token, LEAD, "")).otherwise(token))


def template(token: Column, raw: Column) -> Column:
    """Placeholder or plain word; digits and sentence marks sort before ``A``. ``raw`` is the plain token."""
    marked = F.when((raw >= "0") & (raw < ":"), "#number").when(raw.isin(*UNITS), "#unit").otherwise(raw)
    small = F.when(token.isin(*UNITS), "#unit").otherwise(token)
    capital = F.when(F.upper(token) == token, raw).otherwise("#name")
    return F.when(token < "A", marked).when(raw == token, small).otherwise(capital)


def with_windows(df: DataFrame, lengths: dict[str, list[int]]) -> tuple[DataFrame, Column]:
    """The frame with hashes of windows of each named column of words, and all of them by place, one length after the other.

    A window's hash is made from two windows of half its length, or from two that overlap; so a word costs a few hashes of
    two values, however long the window. Words of two columns have hashes of their own.
    """

    def paired(name: str, apart: int, salt: Column) -> Column:
        return F.zip_with(name, F.slice(name, apart + 1, F.size(name)), lambda a, b: F.xxhash64(salt, a, b))

    half, longest = 2, max(max(of) for of in lengths.values())
    df = df.withColumns({f"_{w}2": paired(w, 1, F.lit(w)) for w in lengths})
    while 2 * half <= longest:
        df = df.withColumns({f"_{w}{2 * half}": paired(f"_{w}{half}", half, F.lit(0)) for w, of in lengths.items() if 2 * half <= max(of)})
        half *= 2

    def of(words: str, n: int) -> Column:
        power = 1 << (n.bit_length() - 1)
        if n == 1:
            hashes = F.transform(words, lambda w: F.xxhash64(F.lit(words), w))
        else:
            hashes = F.col(f"_{words}{n}") if n == power else paired(f"_{words}{power}", n - power, F.lit(n))
        return F.slice(hashes, 1, window_count(F.size(f"_{words}2"), n))

    return df, F.concat(*[of(w, n) for w, all_ in lengths.items() for n in all_])


def window_count(size: Column, length: int) -> Column:
    return F.greatest(size - (length - 1), F.lit(0))


def window_start(place: Column, size: Column, lengths: list[int]) -> Column:
    """Word at which the window at ``place`` among windows of all ``lengths`` starts."""
    first, starts = F.lit(0), F.lit(None).cast("int")
    for n in lengths:
        starts = F.when(place >= first, place - first).otherwise(starts)
        first = first + window_count(size, n)
    return starts


def clashes(slots: str) -> Column:
    """Slots whose item value stood for another value before, with the last such place; ``slots`` has at, item and doc in order."""
    same = F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["item"], s["doc"])))) == F.size(F.array_distinct(F.transform(slots, lambda s: s["item"])))
    before = lambda s: F.filter(slots, lambda o: (o["at"] < s["at"]) & (o["item"] == s["item"]) & (o["doc"] != s["doc"]))
    pairs = F.transform(slots, lambda s: F.struct(s["at"].alias("at"), F.array_max(F.transform(before(s), lambda o: o["at"])).alias("last")))
    return F.when(same, F.array().cast("array<struct<at:int,last:int>>")).otherwise(F.filter(pairs, lambda c: c["last"].isNotNull()))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, passage: int = PASSAGE, shortest: int = 1) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots, verbatim and start (word of the text) for each document and item with a passage."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("t")).distinct()
    items = items.where(F.size("t") >= max(1, shortest)).withColumn("raw", F.transform("t", plain)).select("item_id", "raw", F.zip_with("t", "raw", template).alias("kind"))
    items = items.withColumn("n", F.least(F.size("kind"), F.lit(window))).withColumn("long", F.least(F.size("kind"), F.lit(passage)))
    words = lambda i: F.exists(F.slice("kind", i, F.col("n")), lambda k: ~k.startswith("#"))
    items = items.withColumn("whole", F.size(F.filter(F.sequence(F.lit(1), F.size("kind") - F.col("n") + 1), words)))
    items = stage(items.withColumn("needed", F.greatest(F.col("long") - F.col("n") + 1, F.lit(1))), "items")
    pairs = items.select("n", "long").distinct().collect()  # at most ``window`` and ``passage`` values
    lengths, longs = sorted({r["n"] for r in pairs} or {window}), sorted({r["long"] for r in pairs} or {passage})

    def cut_items(length: str, sizes: list[int], words: str) -> DataFrame:
        """Windows of each item in its own length, with the number of further template windows they hold."""
        own = [with_windows(items.where(F.col(length) == n), {words: [n]}) for n in sizes]
        own = [df.select("item_id", "n", "needed", "whole", "kind", F.lit(n).alias("size"), F.posexplode(all_).alias("at", "window")) for n, (df, all_) in zip(sizes, own)]
        return reduce(DataFrame.union, own)

    worded = F.size(F.filter(F.slice("kind", F.col("at") + 1, F.col("n")), lambda k: ~k.startswith("#")))
    by_kind = cut_items("n", lengths, "kind").where(worded > 0).withColumn("firm", 2 * worded >= F.col("n"))
    known = by_kind.union(cut_items("long", longs, "raw").withColumn("firm", F.lit(True)))
    known = known.select("window", "item_id", "at", (F.col("size") - F.col("n")).alias("more"), "needed", "whole", "firm")
    known = stage(known.distinct(), "item-windows")
    read = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tag"), tokens(F.col("text")).alias("t")).withColumn("raw", F.transform("t", plain))
    read = read.select("doc_id", "tag", F.size("raw").alias("size"), "raw", F.zip_with("t", "raw", template).alias("kind"))
    read, all_ = with_windows(read, {"kind": lengths, "raw": longs})
    seen = read.select("doc_id", "tag", "size", F.posexplode(all_).alias("place", "window"))
    start = window_start(F.col("place"), F.col("size"), lengths + longs)
    hits = join_small(seen, known, "window", "inner").groupBy("doc_id", "tag", "item_id", "needed", "whole", (start - F.col("at")).alias("diagonal"))
    runs = hits.agg(F.collect_set(F.struct("at", "more", "firm")).alias("hits"))  # as many places as the item has, at most, of either kind
    places = lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["more"]))))
    runs = runs.select("doc_id", "tag", "item_id", "diagonal", "needed", "whole", places("hits").alias("places"), places(F.filter("hits", lambda h: h["firm"])).alias("firm"))
    enough, twice = F.size("firm") >= F.col("needed"), F.size("places") >= F.least(2 * F.col("needed"), F.greatest("whole", F.lit(1)))
    runs = runs.where(enough | twice)
    runs = stage(runs.select("*", F.array_min("places").alias("low"), F.array_max("places").alias("high")), "runs")
    ids = stage(runs.select("doc_id", "tag").distinct(), "hit-documents")
    texts = join_small(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text"), ids, ["doc_id", "tag"], "inner").select("doc_id", "tag", tokens(F.col("text")).alias("t"))
    texts = texts.withColumn("doc_raw", F.transform("t", plain)).select("doc_id", "tag", "doc_raw", F.zip_with("t", "doc_raw", template).alias("doc_kind"))
    both = runs.join(texts, ["doc_id", "tag"]).join(items.drop("needed", "whole"), "item_id")
    place = F.sequence(F.col("low"), F.least(F.col("high") + F.col("n") - 1, F.size("doc_kind") - F.col("diagonal") - 1))
    slots = F.transform(
        F.filter(place, lambda i: F.get("kind", i).startswith("#") & ((F.get("kind", i) == F.get("doc_kind", i + F.col("diagonal"))) | (F.get("raw", i) == F.get("doc_raw", i + F.col("diagonal"))))),
        lambda i: F.struct(i.alias("at"), F.get("raw", i).alias("item"), F.get("doc_raw", i + F.col("diagonal")).alias("doc")),
    )
    judged = both.select("doc_id", "item_id", "diagonal", "places", "firm", "needed", "whole", "n", slots.alias("slots")).withColumn("clashes", clashes("slots"))
    # A stretch starts behind a clash's earlier place, or with the run, and ends before the next clash that lies in it.
    behind = F.explode(F.array_distinct(F.concat(F.array(F.lit(-1)), F.transform("clashes", lambda c: c["last"]))))
    cut = judged.withColumn("behind", behind).withColumn("stop", F.array_min(F.transform(F.filter("clashes", lambda c: c["last"] > F.col("behind")), lambda c: c["at"])))
    within = lambda all_: F.filter(all_, lambda p: (p > F.col("behind")) & (F.col("stop").isNull() | (p + F.col("n") <= F.col("stop"))))
    cut = cut.withColumns({"places": within("places"), "firm": within("firm")}).where(enough | twice)
    cut = cut.withColumn("places", F.when(enough, F.col("firm")).otherwise(F.col("places")))
    cut = cut.withColumn("low", F.array_min("places")).withColumn("high", F.array_max("places") + F.col("n"))
    cut = cut.withColumn("slots", F.filter("slots", lambda s: (s["at"] >= F.col("low")) & (s["at"] < F.col("high"))))
    cut = cut.where(enough | (F.size(F.array_distinct(F.transform("slots", lambda s: s["item"]))) >= VALUES))
    kept = cut.select("doc_id", "item_id", F.size("places").alias("n_windows"), (F.col("low") + F.col("diagonal")).alias("start"), "slots")
    verbatim = F.forall("slots", lambda s: s["item"] == s["doc"])
    best = kept.select("doc_id", "item_id", F.struct("n_windows", verbatim.alias("verbatim"), F.size("slots").alias("n_slots"), (-F.col("start")).alias("back")).alias("found"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("found").alias("f"))
    return best.select("doc_id", "item_id", F.col("f.n_windows").alias("n_windows"), F.col("f.n_slots").alias("n_slots"), F.col("f.verbatim").alias("verbatim"), (-F.col("f.back")).alias("start"))
