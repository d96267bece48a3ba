"""URL filters over a sorted digest array.

Rules (host, path, verdict) become one array of sorted 64-bit xxhash keys and the full strings in the same order. Tasks map
both into memory, probe all keys of a slice of addresses with one vectorised binary search, and confirm hits against the
full strings, so colliding digests decide nothing. An array larger than PART_BYTES is cut into ranges of digests; the
addresses pass one range after the other, each sent to the executors by itself, and keep the best rule so far. A rule fits
its host and all subdomains where the address's path starts with the rule's path; the rule with most characters wins, ties
go to the longer host. Of rules with equal host and path the last one given holds.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
``#`` or the end. Null and empty addresses, and those without ``://``, have an empty host and path, fit no rule and get
the default verdict. Repeated rows are judged alike, extra columns are ignored, an empty rule list fits nothing.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stage

#: Measured bytes of digests and strings that are sent to an executor at once.
PART_BYTES = 64 << 20
SCHEMA = "page_id long, host string, path string, key string, verdict string"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_ranges(rules: list[tuple[str, str, str]], digest=xxhash.xxh64_intdigest, most: int = PART_BYTES) -> list[DigestArray]:
    """All rules in order of their digests, cut into arrays of at most ``most`` bytes."""
    last = {_key(h, p): v for h, p, v in rules}
    keys = sorted((digest(k), k, v) for k, v in last.items())
    size = np.cumsum([16 + len(k) + len(v) for _, k, v in keys]) if keys else np.zeros(0)
    parts, start = [], 0
    while start < len(keys):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        parts.append(DigestArray(keys[start:stop], digest))
        start = stop
    return parts


class DigestArray:
    """Sorted digests of rules and their full strings, both mapped from files of the process that uses them."""

    def __init__(self, keys: list[tuple[int, bytes, str]], digest=xxhash.xxh64_intdigest):
        self.digest = digest
        self.packed = np.array([d for d, _, _ in keys], np.uint64).tobytes()
        self.strings = b"".join(k for _, k, _ in keys)
        self.ends = np.cumsum([len(k) for _, k, _ in keys])
        self.names = sorted({v for _, _, v in keys})
        self.verdicts = np.array([self.names.index(v) for _, _, v in keys], np.int32)
        split = [k.decode("utf-8", "surrogatepass").split("\n", 1) for _, k, _ in keys]
        self.labels = sorted({h.count(".") + 1 for h, _ in split})
        self.lengths = sorted({len(p) for _, p in split})
        self.mapped: tuple[np.ndarray, mmap.mmap] | None = None

    def __getstate__(self):
        return self.__dict__ | {"mapped": None}

    def arrays(self) -> tuple[np.ndarray, mmap.mmap]:
        if self.mapped is None:
            self.mapped = np.frombuffer(_mapped(self.packed), np.uint64), _mapped(self.strings)
        return self.mapped

    def full(self, j: int) -> bytes:
        return self.arrays()[1][self.ends[j - 1] if j else 0 : self.ends[j]]

    def probe(self, keys: list[bytes]) -> list[int]:
        """The rule of each key, or -1: binary search over the digests, then the full string of every equal digest."""
        if not keys:
            return []
        array, wanted = self.arrays()[0], np.array([self.digest(k) for k in keys], np.uint64)
        first, last = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
        out = [-1] * len(keys)
        for i in np.flatnonzero(last > first):
            out[i] = next((j for j in range(first[i], last[i]) if self.full(j) == keys[i]), -1)
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Keys that could fit: host endings with as many labels as a rule has, path beginnings as long as a rule's."""
        parts = host.split(".") if host else []
        hosts = [".".join(parts[-n:]) for n in self.labels if n <= len(parts)]
        return [_key(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]


def _key(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode("utf-8", "surrogatepass")


def _mapped(content: bytes) -> mmap.mmap:
    handle, name = tempfile.mkstemp(prefix="digests-")  # of this process alone; gone as soon as it is mapped
    with os.fdopen(handle, "wb+") as file:
        file.write(content)
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    os.unlink(name)
    return view


def _rank(key: str) -> tuple[int, int]:
    return len(key), key.index("\n")


def _judged(rows: DataFrame, part: DigestArray) -> DataFrame:
    """The better of the rule that a row has and the best of this range."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                rows = batch.slice(start, 2000)
                host, path, key, verdict = (rows.column(c).to_pylist() for c in ("host", "path", "key", "verdict"))
                tried = [index.candidates(h, p) for h, p in zip(host, path, strict=True)]
                hits = iter(index.probe([k for keys in tried for k in keys]))
                for i, keys in enumerate(tried):
                    for j in [j for _, j in zip(keys, hits, strict=False) if j >= 0]:
                        found = index.full(j).decode("utf-8", "surrogatepass")
                        if key[i] is None or _rank(found) > _rank(key[i]):
                            key[i], verdict[i] = found, index.names[index.verdicts[j]]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(3)), pa.array(key, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "key", "verdict"])

    return rows.mapInArrow(run, SCHEMA)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", most: int = PART_BYTES) -> DataFrame:
    """page_id, host, path, rule (host and path of the winner, else null) and verdict of every address."""
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), none.alias("key"), none.alias("verdict"))
    parts = digest_ranges(rules, most=most)
    for i, part in enumerate(parts):
        rows = _judged(rows, part)
        if i + 1 < len(parts):  # one range at a time
            rows = stage(rows, "judged")
    rule = F.concat(F.substring_index("key", "\n", 1), F.expr("substring(key, locate(char(10), key) + 1)"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
