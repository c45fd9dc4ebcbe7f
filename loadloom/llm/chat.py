"""Chat formatting: token-level assembly with reserved ids and a loss mask."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import arrow_map


@dataclass(frozen=True)
class Template:
    """A turn is ``turn`` role ``body`` text ``end``. Strings of ``control`` never stand unescaped inside a role or text.

    Escaping doubles each ``escape`` character, then puts one after the first character of each control string; no control
    string has ``escape`` as its second character, so dropping single ones undoes it.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    escape: str = "\\"
    loss_role: str = "assistant"
    control: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "control", (self.turn, self.body, self.end, *self.others))

    def patterns(self):
        control = "|".join(regex.escape(c) for c in sorted(self.control, key=len, reverse=True))
        e = regex.escape(self.escape)
        return regex.compile(control), regex.compile(f"{e}({e})?")


class Formatter:
    """Encodes and decodes conversations with one vocabulary and template."""

    def __init__(self, path: str, pattern: str, template: Template):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.t = template
        top = max(ranks.values()) + 1
        self.turn, self.body, self.end = top, top + 1, top + 2  # reserved ids after the vocabulary
        self.control, self.single = template.patterns()

    def escaped(self, text: str) -> str:
        e = self.t.escape
        return self.control.sub(lambda m: m[0][0] + e + m[0][1:], text.replace(e, e + e))

    def unescaped(self, text: str) -> str:
        return self.single.sub(lambda m: m[1] or "", text)

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
        """Formatted text, ids and loss mask. Segments are encoded apart; the mask comes from prefix sums of their lengths."""
        segments, loss, shown = [], [], []
        for role, text in turns:
            role_text, body = self.escaped(role), self.escaped(text)
            segments += [[self.turn], self.lib.encode_ordinary(role_text), [self.body], self.lib.encode_ordinary(body), [self.end]]
            loss += [0, 0, 0, int(role == self.t.loss_role), 0]
            shown += [self.t.turn, role_text, self.t.body, body, self.t.end]
        ends = np.cumsum([len(s) for s in segments], dtype=np.int64)
        edges = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int32)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        np.add.at(edges, starts, loss)
        np.subtract.at(edges, ends, loss)
        ids = np.concatenate([np.asarray(s, dtype=np.int32) for s in segments]) if segments else np.zeros(0, np.int32)
        return "".join(shown), ids, np.cumsum(edges[:-1], dtype=np.int32).astype(np.int8)

    def turns_of(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Read the turns back from the ids."""
        at = np.flatnonzero(ids >= self.turn)
        found = []
        for a, b, c in zip(at[0::3], at[1::3], at[2::3], strict=True):
            found.append(tuple(self.unescaped(self.lib.decode(ids[x + 1 : y].tolist())) for x, y in ((a, b), (b, c))))
        return found

    def loss_text(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the mask, segment by segment, unescaped."""
        m = np.concatenate([[0], mask, [0]]).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(m) == 1), np.flatnonzero(np.diff(m) == -1)
        return "".join(self.unescaped(self.lib.decode(ids[a:b].tolist())) for a, b in zip(starts, ends, strict=True))


_formatters: dict[tuple, Formatter] = {}


def formatter(path: str, pattern: str, template: Template) -> Formatter:
    key = (path, pattern, template)
    if key not in _formatters:
        _formatters[key] = Formatter(*key)
    return _formatters[key]


def chat_format(turns: DataFrame, tokenizer: str, pattern: str, template: Template | None = None) -> DataFrame:
    """One row for each conversation: conv_id, formatted (text), input_ids, loss_mask (1 over assistant text).

    Rows are put in order of turn; ties by role, then text. Segments are encoded apart and reserved ids spliced between them,
    so no text can make a reserved id; control strings in roles and texts are escaped reversibly.
    One shuffle by conversation; the group is one conversation, which the result holds in one row in any case.
    Null text or role: empty. Null conv_id: one conversation of its own. Null turn: first. Repeated rows: repeated turns.
    Empty table: no rows. Other columns are ignored.
    """
    t = template or Template()
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = formatter(tokenizer, pattern, t)
        made = [f.assemble(list(zip(r, x, strict=True))) for r, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        columns = [
            batch.column(0),
            pa.array([m[0] for m in made], pa.string()),
            pa.array([m[1] for m in made], pa.list_(pa.int32())),
            pa.array([m[2] for m in made], pa.list_(pa.int8())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "input_ids", "loss_mask"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return arrow_map(grouped, build, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<tinyint>")


def chat_digest(formatted: DataFrame, tokenizer: str, pattern: str, template: Template | None = None) -> DataFrame:
    """Read each formatted conversation back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    from hashlib import sha256

    t = template or Template()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = formatter(tokenizer, pattern, t)
        rows = []
        for shown, ids, mask in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            ids, mask = np.asarray(ids, dtype=np.int64), np.asarray(mask, dtype=np.int8)
            turns, loss = f.turns_of(ids), f.loss_text(ids, mask)
            told = sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            rows.append((len(turns), told, len(loss), sha256(loss.encode()).hexdigest(), len(shown)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return arrow_map(formatted, digest, schema)
