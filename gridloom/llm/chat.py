"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags.

Turns become an opening, a text and a closing segment. Control strings inside texts get a backslash in front, which
``read_back`` takes off again; the role of an unknown kind is written behind ``~``. The machine follows the template's
moves; the first turn it has no move for, or a conversation that ends where none may, makes ``valid`` false from there on.
Invalid conversations are formatted all the same.

Conversations are dealt by conv_id and sorted by turn, role and text; tasks stream them, holding one turn at a time, so a
conversation of any length needs no more memory than its longest turn. Null texts and roles are empty; rows without
conv_id are one conversation; repeated rows are turns of their own; equal turn numbers go by role and text; null turns
come first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``{}`` in ``opening`` stands for the role. ``moves``: from the last role (None: start) to those that may follow."""

    opening: str = "### {}: "
    closing: str = " </turn>\n"
    controls: tuple[str, ...] = ("\\", "###", "</turn>")
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    moves: dict[str | None, frozenset[str]] = field(
        default_factory=lambda: {
            None: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    ends: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        self_ = object.__setattr__
        any_control = "|".join(map(re.escape, self.controls))
        stop = self.closing.strip()
        if "\\" not in self.controls or stop not in self.controls:
            raise ValueError("backslash and the closing mark have to be control strings")
        self_(self, "find", re.compile(any_control))
        self_(self, "escaped", re.compile(rf"\\({any_control})"))
        self_(self, "stop", re.compile(rf"\\(?:{any_control})|{re.escape(stop)}"))
        self_(self, "roles", {v: k for k, v in self.names.items()})

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)

    def show(self, role: str) -> str:
        return self.names.get(role) or "~" + re.sub(r"[\\:#<\n]", lambda m: "\\" + m[0], role)

    def role(self, shown: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", shown[1:]) if shown.startswith("~") else self.roles[shown]

    def turn(self, formatted: str) -> tuple[str, str] | None:
        """Role and text if the string is one whole turn, else None."""
        stop = next((m for m in self.stop.finditer(formatted) if not m[0].startswith("\\")), None)
        before, after = self.opening.split("{}")
        lead = self.closing[: len(self.closing) - len(self.closing.lstrip())]
        if stop is None or not formatted.endswith(self.closing):
            return None
        shown = re.match(rf"(?s)((?:\\.|[^\\:])*){re.escape(after)}", formatted[len(before) :])
        start = len(before) + shown.end()
        return self.role(shown[1]), self.unescape(formatted[start : stop.start() - len(lead)])


SEGMENTS = "conv_id long, seq long, role string, part string, segment string, loss boolean, valid boolean"


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Three rows a turn in order of ``seq``; joined, a conversation's segments are its formatted text."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        conv, seq, state, valid, begun = None, 0, None, True, False
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for c, role, text in zip(*(x.slice(start, 500).to_pylist() for x in batch.columns), strict=True):
                    if not begun or c != conv:
                        conv, seq, state, valid, begun = c, 0, None, True, True
                    valid = valid and role in template.moves.get(state, ())
                    state = role
                    opening, closing = template.opening.format(template.show(role)), template.closing
                    for part, segment, loss in (("open", opening, False), ("text", template.escape(text), role in template.loss), ("close", closing, False)):
                        rows.append((c, seq, role, part, segment, loss, valid))
                        seq += 1
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["conv_id", "seq", "role", "part", "segment", "loss", "valid"])

    return dealt.mapInArrow(run, SEGMENTS)


class Reader:
    """Reads a conversation back from its formatted segments and their loss flags alone."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template, self.buffer = conv_id, template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns, self.loss_chars, self.chars, self.valid, self.last = 0, 0, 0, True, None

    def feed(self, segment: str, loss: bool, valid: bool) -> None:
        self.buffer += segment
        self.chars += len(segment)
        self.valid = valid
        if loss:
            text = self.template.unescape(segment)
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        if segment == self.template.closing and (turn := self.template.turn(self.buffer)):
            self.turns.update(f"{turn[0]}\n{turn[1]}\n".encode())
            self.n_turns += 1
            self.last = turn[0]
            self.buffer = ""

    def row(self):
        valid = self.valid and self.last in self.template.ends
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from segments that lie together in order, as ``segments`` leaves them."""
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches):
        reader = None
        for batch in batches:
            done = []
            for c, segment, loss, valid in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss", "valid")), strict=True):
                if reader is None or c != reader.conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(c, template)
                reader.feed(segment, loss, valid)
            if done:
                yield _rows(done, names)
        if reader is not None:
            yield _rows([reader.row()], names)

    return formatted.select("conv_id", "segment", "loss", "valid").mapInArrow(run, READ)


def _rows(done: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds, strict=True)], names=names)
