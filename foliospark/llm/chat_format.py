"""Chat formatting: conversations as training windows of a token budget, with a loss mask, and back again.

A turn is written as start mark, role, text mark, text, end mark. Control strings inside roles and texts get an escape
character behind their first one; where they have some already they get one more, so that reading back is exact.

A window is a run of whole turns. Prefix sums of the turns' tokens choose it: as much history as its own limit allows,
then new turns up to the budget. The system turn stands before every window of its conversation. Only new assistant
turns are targets; what is repeated (system turn, history) is masked, so that each target counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .token_align import BYTE_BPE, VOCABULARIES, byte_tokenizer, content

#: Tokens of a window, and of the history repeated in it.
BUDGET, HISTORY = 1024, 256


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the control strings that texts may hold only in escaped form."""

    start: str = "<|start|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    escape: str = "\ue000"  # of the private use area
    system: str = "system"
    target: str = "assistant"
    firsts: dict[str, str] = field(init=False, repr=False)

    def __post_init__(self):
        controls = {self.start, self.text, self.end, *self.others}
        for c in controls:
            if len(c) < 2 or self.escape in c or any(c != d and c in d for d in controls):
                raise ValueError(f"control string {c!r} is too short, holds the escape or is part of another")
        if any(m[0] in m[1:] for m in (self.start, self.text, self.end)):
            raise ValueError("a mark's first character stands in it again")
        rests: dict[str, list[str]] = {}
        for c in sorted(controls):
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        object.__setattr__(self, "firsts", {re.escape(f): f"(?={'|'.join(r)})" for f, r in rests.items()})

    def escaped(self, text: Column) -> Column:
        """Behind the first character of each control string one escape more."""
        return F.regexp_replace(text, "|".join(f"{f}{self.escape}*{rest}" for f, rest in self.firsts.items()), f"$0{self.escape}")

    def unescaped(self, text: Column) -> Column:
        """One escape less."""
        pattern = "|".join(f"({f}{self.escape}*){self.escape}{rest}" for f, rest in self.firsts.items())
        return F.regexp_replace(text, pattern, "".join(f"${i + 1}" for i in range(len(self.firsts))))


WINDOW = "window int, formatted string, mask array<struct<start:int,length:int>>, n_repeated int, n_turns int, n_tokens int"


@dataclass
class Conversation:
    """A conversation as its turns come in: no more is held than history, the open window and what came since."""

    conv_id: object
    budget: int
    history: int
    system: tuple | None = None
    turns: list[tuple] = field(default_factory=list)
    done: int = 0
    number: int = 0
    seen: int = 0

    def add(self, turn: tuple, is_system: bool) -> Iterator[dict]:
        self.seen += 1
        if is_system and self.seen == 1:
            self.system = turn
            return
        self.turns.append(turn)
        if len(self.turns) - self.done >= 4096:
            yield from self.windows(last=False)

    def windows(self, last: bool) -> Iterator[dict]:
        """All windows that later turns can't change; with last, all."""
        room = self.budget - (self.system[0] if self.system else 0)
        prefix = np.concatenate([[0], np.cumsum([t[0] for t in self.turns], dtype=np.int64)])
        n = len(self.turns)
        while self.done < n:
            s = self.done
            first = int(np.searchsorted(prefix, prefix[s] - self.history))
            end = int(np.searchsorted(prefix, prefix[first] + room, "right")) - 1
            if end <= s:  # the next turn leaves no room for so much history, perhaps for none
                end = s + 1
                first = min(s, int(np.searchsorted(prefix, prefix[end] - room)))
            if end >= n and not last:
                break
            yield self.window(first, s, end)
            self.done = end
        if last and not self.number and self.system:
            yield self.window(0, 0, 0)
        keep = int(np.searchsorted(prefix, prefix[self.done] - self.history))
        self.turns, self.done = self.turns[keep:], self.done - keep

    def window(self, first: int, new: int, end: int) -> dict:
        turns = ([self.system] if self.system else []) + self.turns[first:end]
        repeated = (new - first) + (1 if self.system and self.number else 0)
        mask, at = [], 0
        for k, (_, piece, start, length, target) in enumerate(turns):
            if target and k >= repeated:
                mask.append({"start": at + start, "length": length})
            at += len(piece)
        self.number += 1
        return {"conv_id": self.conv_id, "window": self.number - 1, "formatted": "".join(t[1] for t in turns), "mask": mask, "n_repeated": repeated, "n_turns": len(turns), "n_tokens": sum(t[0] for t in turns)}


def _streamed(batches: Iterable[pa.RecordBatch], schema: pa.Schema, rows_of) -> Iterator[pa.RecordBatch]:
    """rows_of(rows of sorted batches), in batches of 8 MB or so."""
    out, size = [], 0
    for row in rows_of(r for batch in batches for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
        out.append(row)
        size += 100 + len(row.get("formatted", ""))
        if size > 1 << 23:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, template: Template = Template(), path: str = VOCABULARIES, byte_bpe: str = BYTE_BPE) -> DataFrame:
    """(conv_id, window, formatted, mask, n_repeated, n_turns, n_tokens) from turns (conv_id, turn, role, text).

    mask has the targets' places in `formatted` in code points; the first n_repeated turns stood in earlier windows.
    A turn over the budget is a window without history of its own, whole, the only kind (with the system turn's share)
    whose n_tokens may pass it. A system turn is one only as a conversation's first.

    Null roles and texts are empty. Rows go by turn (null first), ties by role and text; repeated rows are turns, too.
    Rows with a null conv_id are one conversation. Other columns are not read. An empty table gives no window.
    Conversations flow through their task sorted, in the memory of a window and the longest turn.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    body, head = template.escaped(text), F.concat(F.lit(template.start), template.escaped(role), F.lit(template.text))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.concat(head, body, F.lit(template.end)).alias("piece"), F.length(head).alias("start"), F.length(body).alias("length"), (F.col("role") == template.system).alias("system"), (F.col("role") == template.target).alias("target"))
    vocabulary = content(path, byte_bpe)
    id_type = turns.schema["conv_id"].dataType

    def formed(batches):
        encode = byte_tokenizer(vocabulary)[0].encode_ordinary

        def each(rows):
            now = None
            for r in rows:
                if now is None or r["conv_id"] != now.conv_id:
                    if now:
                        yield from now.windows(last=True)
                    now = Conversation(r["conv_id"], budget, history)
                yield from now.add((len(encode(r["piece"])), r["piece"], r["start"], r["length"], r["target"]), r["system"])
            if now:
                yield from now.windows(last=True)

        return _streamed(batches, schema, each)

    out = f"conv_id {id_type.simpleString()}, {WINDOW}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.mapInArrow(formed, out)


def read_back(formed: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, window, turns, loss, formatted_chars): a window's new turns as (role, text), and its targets' texts."""
    pieces = F.split("formatted", re.escape(template.start))
    new = F.slice(pieces, F.col("n_repeated") + 2, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    role = lambda t: F.substring_index(t, template.text, 1)
    text = lambda t: F.substring(t, F.length(role(t)) + len(template.text) + 1, F.length(t) - F.length(role(t)) - len(template.text) - len(template.end))
    turns = F.transform(new, lambda t: F.struct(template.unescaped(role(t)).alias("role"), template.unescaped(text(t)).alias("text")))
    loss = F.transform("mask", lambda m: template.unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formed.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(formed: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations, read back from windows.

    Digests run along with a conversation's windows in their order; nothing of a conversation is gathered.
    """
    rows = read_back(formed, template).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def each(rows):
        now = None
        for r in rows:
            if now is None or r["conv_id"] != now["conv_id"]:
                if now:
                    yield finished(now)
                now = {"conv_id": r["conv_id"], "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
            for t in r["turns"]:
                now["turns"].update(f"{t['role']}\n{t['text']}\n".encode())
            for t in r["loss"]:
                now["loss"].update(t.encode())
            now["n_turns"] += len(r["turns"])
            now["loss_chars"] += sum(map(len, r["loss"]))
            now["formatted_chars"] += r["formatted_chars"]
        if now:
            yield finished(now)

    def finished(now):
        return {k: v for k, v in now.items() if k not in ("turns", "loss")} | {f"{k}_sha256": now[k].hexdigest() for k in ("turns", "loss")}

    return rows.mapInArrow(lambda batches: _streamed(batches, schema, each), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
