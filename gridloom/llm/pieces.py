"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation has the largest sum of the model's piece scores; ties prefer the longer last piece. Scores are kept
for a window as long as the longest piece; backpointers are kept until all paths that can still win run through one
boundary, then the ids up to it are committed and forgotten. The runs between spaces that a slice of texts brings anew are
read in order, each from the end of what it shares with the one before.

Texts are taken as they are: a space becomes the space mark and one mark is put in front, as the format does. Characters
without a piece, and a space mark that stands in the text itself, become byte pieces, so decoding returns every text
byte for byte, also texts that are not valid UTF-8.

Null texts have null ids; empty texts have no ids; a text of any length is encoded whole; repeated rows are encoded
alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import Cached, over_texts

MARK = "▁"
#: Longest run between spaces of which the ids are remembered.
REMEMBERED = 64
#: Characters up to which a text's runs are listed at once, and runs of a longer text that are.
LISTED, TAKEN = 1 << 20, 1 << 16
_NONE = float("-inf")


class Pieces:
    """Pieces, scores and byte pieces of a model; ``longest`` bounds the encoder's window."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces: texts could not be returned exactly")
        plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}
        self.longest = max(map(len, scores))
        self.fallback = min(s for s, _ in scores.values()) - 10.0
        self.raw = [b""] * len(sp)
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        # Pieces by their characters from last to first; a node holds score and id, or -1, and the nodes before it.
        self.ends: dict[str, tuple[float, int, dict]] = {}
        for piece, (score, i) in sorted(scores.items(), key=lambda x: len(x[0])):
            self.raw[i] = piece.replace(MARK, " ").encode()
            nodes = self.ends
            for c in reversed(piece[1:]):
                nodes = nodes.setdefault(c, (0.0, -1, {}))[2]
            nodes[piece[0]] = (score, i, {})
        # Where no piece goes on into a space mark, every path has a boundary before each run of marks.
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if not any(re.search(f"[^{MARK}]{MARK}", p) for p in scores) else "(?s).+")
        self.packed = [array("i", [i]).tobytes() for i in range(len(sp))]
        self.known = Cached(lambda run: array("i", self.segment(run)).tobytes(), 400_000)

    def char_bytes(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogateescape")]

    def segment(self, text: str) -> list[int]:
        stream = Stream(self)
        stream.push(text)
        return stream.finish()

    def segment_sorted(self, runs: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Short runs with their ids: what ``Stream`` does, from the boundaries that a run shares with the one before it."""
        ends, fallback = self.ends, self.fallback
        scores, spelled, before = [0.0], [b""], ""
        for run in sorted(runs):
            shared = 0
            for a, b in zip(before, run):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], spelled[shared + 1 :]
            for last in range(shared, len(run)):
                best, start, piece, at = _NONE, last, -1, last
                node = ends.get(run[last])
                alone = node is not None and node[1] >= 0
                while node is not None:
                    score, found, further = node
                    if found >= 0:
                        value = scores[at] + score
                        if value >= best:
                            best, start, piece = value, at, found
                    if not at or not further:
                        break
                    at -= 1
                    node = further.get(run[at])
                if not alone and scores[last] + fallback > best:
                    best, start, piece = scores[last] + fallback, last, -1
                scores.append(best)
                spelled.append(spelled[start] + (self.packed[piece] if piece >= 0 else array("i", self.char_bytes(run[last])).tobytes()))
            yield run, spelled[-1]
            before = run

    def runs(self, text: bytes) -> Iterator[list[str] | None]:
        """The runs of a text in order, in lists; None stands for a space mark of the text itself."""
        for i, part in enumerate(text.decode("utf-8", "surrogateescape").split(MARK) if text else ()):
            if i:
                yield None
            marked = ("" if i else MARK) + part.replace(" ", MARK)
            if len(marked) <= LISTED:
                yield self.cut.findall(marked)
            else:
                found = map(re.Match.group, self.cut.finditer(marked))
                while some := list(islice(found, TAKEN)):
                    yield some

    def encode(self, text: bytes) -> bytes:
        """Ids as 32-bit integers in a row."""
        out, mark = [], array("i", self.char_bytes(MARK)).tobytes()
        for runs in self.runs(text):
            if runs is None:
                out.append(mark)
            elif max(map(len, runs), default=0) <= REMEMBERED:
                out += map(self.known.__getitem__, runs)
            else:
                out += [self.known[run] if len(run) <= REMEMBERED else array("i", self.segment(run)).tobytes() for run in runs]
        return b"".join(out)

    def encode_all(self, texts: Iterable[bytes | None]) -> list[bytes | None]:
        """Ids of each text; the short runs that are not remembered are segmented together, some at a time."""
        given, known, out, start = list(texts), self.known, [], 0
        while start < len(given):
            new, end = set(), start
            while end < len(given) and len(new) < known.half:
                for runs in self.runs(given[end] or b""):
                    if len(new) < known.half:
                        new.update([r for r in set(runs or ()) if r not in known and r not in known.before and len(r) <= REMEMBERED])
                end += 1
            known.add(self.segment_sorted(new), len(new))
            out += [None if t is None else self.encode(t) for t in given[start:end]]
            start = end
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))[1:]


class Stream:
    """Viterbi over characters as they come. ``committed`` grows; ``back`` reaches from the last commit to the end."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.committed = pieces, []
        self.window: list[float] = [0.0]  # best scores of the last boundaries, at least ``longest`` of them
        self.text = ""  # characters since the last commit
        self.back: list[tuple[int, int]] = [(0, -1)]  # per boundary since the commit: where its piece starts, its id
        self.widest = 0

    def push(self, chars: str) -> None:
        ends, fallback, window, back = self.pieces.ends, self.pieces.fallback, self.window, self.back
        longest, most = self.pieces.longest, 2 * self.pieces.longest
        text, base = self.text + chars, 0  # the last commit is at ``base``
        for at in range(len(self.text), len(text)):
            end, length, best, reach, piece = len(back), 1, _NONE, 1, -1
            node = ends.get(text[at])
            alone = node is not None and node[1] >= 0
            while node is not None:
                score, found, further = node
                if found >= 0:
                    value = window[-length] + score
                    if value >= best:
                        best, reach, piece = value, length, found
                if length == end or not further:
                    break
                node = further.get(text[at - length])
                length += 1
            if not alone and window[-1] + fallback > best:
                best, reach, piece = window[-1] + fallback, 1, -1
            window.append(best)
            back.append((end - reach, piece))
            if len(window) > most:
                del window[:-longest]
            if len(back) > most and (shared := self._shared()):
                self._take(shared, text, base)
                back = self.back = [(0, -1), *((s - shared, i) for s, i in back[shared + 1 :])]
                base += shared
        self.text = text[base:]

    def _shared(self) -> int:
        """The last boundary that the paths of all boundaries in the window share; 0 is the last commit."""
        end = len(self.back) - 1
        self.widest = max(self.widest, len(self.back))
        alive = set(range(max(0, end - self.pieces.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0])
        return alive.pop()

    def _take(self, end: int, text: str, base: int) -> None:
        path = []
        while end:
            start, piece = self.back[end]
            path.append(piece if piece >= 0 else self.pieces.char_bytes(text[base + end - 1]))
            end = start
        for piece in reversed(path):
            self.committed += piece if isinstance(piece, list) else [piece]

    def finish(self) -> list[int]:
        self._take(len(self.back) - 1, self.text, 0)
        return self.committed


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """Once per process and model."""
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids returned the text. The model is sent once to each executor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch):
        pieces = load(shared.value)
        given = part.column("text").cast(pa.binary()).to_pylist()
        packed = pieces.encode_all(given)
        flat = np.frombuffer(b"".join(p or b"" for p in packed), np.int32)
        sizes = np.array([len(p or b"") // 4 for p in packed], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        exact = [None if t is None else pieces.decode(flat[at[i] : at[i + 1]].tolist()) == t for i, t in enumerate(given)]
        missing = pa.array([t is None for t in given])
        ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat), mask=missing)
        return {"doc_id": part.column("doc_id"), "ids": ids, "n_ids": [None if t is None else int(n) for t, n in zip(given, sizes, strict=True)], "exact": exact}

    return over_texts(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>, n_ids long, exact boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids are a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = [None if ids is None else load(shared.value).decode(ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
