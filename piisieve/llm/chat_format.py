"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn:

    turn := OPEN role "\\n" text CLOSE "\\n"

with the markers of :class:`ChatTemplate`. ``control`` lists every string that must not occur inside
a role or a text: the markers and the control strings of other common chat formats. A strict,
deterministic parser (:func:`parse_turns`) accepts exactly that grammar. Each turn is rendered
plainly first, parsed back and compared with its source; where that differs (a control string
inside a text, or text that looks escaped) the role and text are escaped one step further and the
turn is parsed again, until the recovered turn is identical.

Escaping is reversible: a control string ``c`` followed by nothing special is written with one
escape mark after its first character, and text that already holds ``k`` marks there gets ``k + 1``.
Unescaping removes one mark.

Defined results: null role and null text count as empty; turns are ordered by (turn, nulls last;
role; text) and repeated rows all stay; a null conversation id is a conversation of its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: control strings of common chat formats ----
CONTROL_STRINGS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
                   "<<SYS>>", "<</SYS>>", "<unk>")
# ---- end of fixed values ----


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of the rendered form; ``loss_roles`` are the roles whose text is trained on."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    control: tuple[str, ...] = CONTROL_STRINGS
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)

    @cached_property
    def _escaped(self) -> re.Pattern:
        """A control string with any number of escape marks after its first character."""
        e = re.escape(self.escape)
        names = sorted({*self.control, self.open, self.close}, key=len, reverse=True)
        return re.compile("|".join(f"(?:{re.escape(c[0])}(?={e}*{re.escape(c[1:])}))" for c in names))

    @cached_property
    def _marked(self) -> re.Pattern:
        e = re.escape(self.escape)
        names = sorted({*self.control, self.open, self.close}, key=len, reverse=True)
        return re.compile("|".join(f"(?:(?<={re.escape(c[0])}){e}(?={e}*{re.escape(c[1:])}))" for c in names))

    @cached_property
    def _control(self) -> re.Pattern:
        names = sorted({*self.control, self.open, self.close}, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, names)))

    def escape_text(self, text: str) -> str:
        return self._escaped.sub(lambda m: m.group() + self.escape, text)

    def unescape_text(self, text: str) -> str:
        return self._marked.sub("", text)

    def escape_role(self, role: str) -> str:
        """A role stays on its line: line feeds (and the percent sign that writes them) are percent-coded."""
        return self.escape_text(role.replace("%", "%25").replace("\n", "%0A"))

    def unescape_role(self, role: str) -> str:
        return self.unescape_text(role).replace("%0A", "\n").replace("%25", "%")


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def render_turn(t: ChatTemplate, role: str, text: str) -> str:
    return f"{t.open}{role}\n{text}{t.close}\n"


def parse_turns(t: ChatTemplate, rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end are the text's place in ``rendered``.

    Deterministic: at each point one marker is legal, and any other control string is an error.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(t.open, at):
            raise GrammarError(f"no turn opens at {at}")
        line = rendered.find("\n", at + len(t.open))
        if line < 0:
            raise GrammarError(f"the role at {at} does not end")
        role = rendered[at + len(t.open):line]
        m = t._control.search(rendered, line + 1)
        if t._control.search(role) or m is None or m.group() != t.close or rendered[m.end():m.end() + 1] != "\n":
            raise GrammarError(f"the turn at {at} holds a control string or does not close")
        turns.append((t.unescape_role(role), t.unescape_text(rendered[line + 1:m.start()]), line + 1, m.start()))
        at = m.end() + 1
    return turns


def format_turn(t: ChatTemplate, role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn and the place of its text; escapes until the parser recovers the source."""
    role_form, text_form = role, text
    while True:
        rendered = render_turn(t, role_form, text_form)
        try:
            (found,) = parse_turns(t, rendered)
            if found[:2] == (role, text):
                return rendered, found[2], found[3]
        except ValueError:  # no single turn, or not the grammar
            pass
        if (role_form, text_form) == (t.escape_role(role), t.escape_text(text)):
            raise GrammarError(f"a turn cannot be written reversibly: {rendered[:200]!r}")
        role_form, text_form = t.escape_role(role), t.escape_text(text)


TURN_SCHEMA = ("conv_id {id}, turn long, n_role string, n_text string, segment string, text_start long, "
               "text_end long, in_loss boolean")


def format_conversations(df: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``segment`` (its rendered form), the place of its text inside the segment and
    whether it is under the loss mask. A conversation's output is its segments joined in (turn, role,
    text) order, so no row ever holds a whole conversation. Narrow: no shuffle, and memory is one
    Arrow batch. Columns: conv_id, turn, n_role, n_text (null-free sources), segment, text_start,
    text_end, in_loss.
    """
    src = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit("")).alias("n_role"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("n_text"))
    id_type = src.schema["conv_id"].dataType.simpleString()
    loss_roles = template.loss_roles

    def run(batches):
        for b in batches:
            roles, texts = b.column("n_role").to_pylist(), b.column("n_text").to_pylist()
            out = [format_turn(template, r, x) for r, x in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int64()), pa.array([r in loss_roles for r in roles], pa.bool_())],
                names=["conv_id", "turn", "n_role", "n_text", "segment", "text_start", "text_end", "in_loss"])

    return src.mapInArrow(run, TURN_SCHEMA.format(id=id_type))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of what the parser recovers from the rendered conversations, one row per conversation:
    n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and loss_sha256
    (the text under the loss mask), formatted_chars.

    Rows are shuffled by conversation and sorted inside partitions; a conversation is streamed
    through running digests, so a very long one needs no more memory than one batch.
    """
    import hashlib

    rows = formatted.select("conv_id", "turn", "n_role", "n_text", "segment", "text_start", "text_end", "in_loss")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    keyed = (rows.repartition("conv_id")
                 .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "n_role", "n_text")
                 .select("conv_id", "segment", "text_start", "text_end", "in_loss"))

    def run(batches):
        def row():
            return (current, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

        started, current = False, None
        for b in batches:
            done = []
            for conv, segment, start, end, in_loss in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != current:
                    if started:
                        done.append(row())
                    started, current = True, conv
                    turns, loss_chars, chars, whole, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse_turns(template, segment):
                    turns += 1
                    whole.update(f"{role}\n{text}\n".encode())
                if in_loss:
                    masked = template.unescape_text(segment[start:end])
                    loss_chars += len(masked)
                    loss.update(masked.encode())
                chars += len(segment)
            yield _digest_batch(done, b.schema.field("conv_id").type)
        if started:
            yield _digest_batch([row()], b.schema.field("conv_id").type)

    return keyed.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _digest_batch(rows, id_type):
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
