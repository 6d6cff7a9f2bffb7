"""Conversations as training text: a template with per-segment loss flags, turn order checked by a finite-state machine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are trained on, and which role may follow which ('' is the start; ``final`` may end).

    Every control string holds ``mark``, two characters that no escaped text holds next to each other.
    """

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    mark: str = "<|"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        first, second = self.mark
        if first == second or "\\" in self.mark or self.mark not in self.before or self.mark not in self.after or self.before.count("{role}") != 1:
            raise ValueError("a template names the role once, and both its parts hold its mark of two different characters")

    def patterns(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        """What ``escape`` and ``unescape`` look for, and a whole turn."""
        first, second = map(re.escape, self.mark)
        head, tail = map(re.escape, self.before.split("{role}"))
        turn = rf"{head}([\w;\\ -]*?){tail}(.*){re.escape(self.after)}"
        return re.compile(rf"{first}(\\*){second}"), re.compile(rf"{first}(\\*)\\{second}"), re.compile(turn, re.DOTALL | re.ASCII)


DEFAULT = Template()


def escape(text: str, template: Template = DEFAULT) -> str:
    """No control string is left: one backslash more between the characters of each mark."""
    first, second = template.mark
    return template.patterns()[0].sub(lambda m: f"{first}{m[1]}\\{second}", text)


def unescape(text: str, template: Template = DEFAULT) -> str:
    first, second = template.mark
    return template.patterns()[1].sub(lambda m: f"{first}{m[1]}{second}", text)


def escape_role(role: str) -> str:
    """Letters, digits, blanks, dashes and low lines stay; any other character becomes its code."""
    return re.sub(r"[^A-Za-z0-9_ -]", lambda m: f"\\{ord(m[0]):x};", role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\([0-9a-f]+);", lambda m: chr(int(m[1], 16)), role)


def in_order(turns: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """Rows of a conversation together and in order; ties by role and text, nulls first."""
    wanted = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Segments (``conv_id``, ``position``, ``part``, ``text``, ``loss``, ``valid``) that make the training text when joined in order.

    ``position`` counts turns from 0 whatever their numbers; ``part`` 0 opens the turn, 1 is its escaped
    text, 2 closes it. A last segment without text at position = turns ends the conversation; its
    ``valid`` says whether the whole order is right. ``valid`` turns false at the first turn that may not
    follow; such conversations are formatted like any other. Null roles and texts are empty; null
    conversation ids make one conversation; repeated rows are turns of their own; other columns are
    ignored. Turns stream through in order, so a conversation of any length needs the memory of one turn.
    """
    template = template or DEFAULT
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, valid, begun = None, "", 0, True, False
        type_ = None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (type_, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "position", "part", "text", "loss", "valid"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            rows, size = [], 0
            for now, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if begun and now != conv:
                    rows.append((conv, position, 0, "", False, valid and state in template.final))
                if not begun or now != conv:
                    conv, state, position, valid, begun = now, "", 0, True, True
                valid = valid and role in template.follows.get(state, ())
                state = role
                rows += [(conv, position, 0, template.before.replace("{role}", escape_role(role)), False, valid), (conv, position, 1, escape(text, template), role in template.trained, valid), (conv, position, 2, template.after, False, valid)]
                position += 1
                size += len(text)
                if size > 4 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            yield flush(rows)
        if begun:
            yield flush([(conv, position, 0, "", False, valid and state in template.final)])

    return in_order(turns, conv_col, turn_col).mapInArrow(run, f"conv_id {kind}, position long, part int, text string, loss boolean, valid boolean")


def read_chat(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, parsed back from segments that ``format_chat`` made by the same template; they come whole and in order within partitions.

    A turn that the template doesn't match is an error.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``valid``.
    """
    template = template or DEFAULT
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, n_turns, loss_chars, chars, pending = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
        whole = template.patterns()[2]
        for batch in batches:
            rows = []
            for conv, part, text, trained, valid in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "text", "loss", "valid")), strict=True):
                if part == 0 and not text:  # the end of the conversation
                    rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                    continue
                chars += len(text)
                if trained:
                    plain = unescape(text, template)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                pending += text
                if part == 2:
                    turn = whole.fullmatch(pending)
                    if turn is None:
                        raise ValueError("a turn doesn't match the template")
                    turns.update(f"{unescape_role(turn[1])}\n{unescape(turn[2], template)}\n".encode())
                    n_turns += 1
                    pending = ""
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
