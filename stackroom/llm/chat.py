"""Chat formatting by a finite-state machine and a declarative template.

Turns are dealt by conversation and sorted by turn; the machine walks them as a stream, one turn at a time, so a
conversation of any length takes bounded memory. Each turn gives the template's segments, each with a loss flag;
the machine's verdict on the turn order goes with them. `read_back` is the inverse: it parses segments into turns.

Text is escaped so that no control string can appear inside it: a run of backslashes between "<" and "|" grows by
one. Roles also escape backslashes and line feeds. Both are undone exactly.

Defined results: a null text or role is empty. Rows of a null conv_id form one conversation. Equal turns are ordered
by role, then text. A turn out of order is emitted all the same, with valid = false from there on. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
_FIELD = re.compile(r"\{(role|text)\}")


@dataclass(frozen=True)
class Template:
    """parts of a turn: (pattern, whether it is in the loss of a trained role). Patterns hold {role} and {text}, each in
    one part at least, and any text between; where a part holds both, something must lie between them."""

    parts: tuple[tuple[str, bool], ...] = ((START + "{role}\n", False), ("{text}", True), (END + "\n", False))
    trained: frozenset[str] = frozenset({"assistant"})
    #: From each state, the roles that may come next; a role is also the next state.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        whole = "".join(p for p, _ in self.parts)
        if "{role}" not in whole or "{text}" not in whole:
            raise ValueError("a template needs {role} and {text}")
        for i, (p, _) in enumerate(self.parts):
            marks = _FIELD.findall(p)
            if "text" in marks[:-1] or re.search(r"\}\{", p) or self.delimiter(i).isalnum() or self.delimiter(i) == "\\":
                raise ValueError(f"part {p!r}: a text comes once and last, behind a role and a mark that is no letter or digit")

    def delimiter(self, part: int) -> str:
        """First character of what follows the role in a part that holds the text too; such a character is escaped in
        roles. Without one, the empty string."""
        found = re.search(r"\{role\}(?=(.)).*\{text\}", self.parts[part][0], re.S)
        return found[1] if found else ""

    def rendered(self, part: int, role: str, text: str) -> str:
        """A part with both placeholders filled, in one pass."""
        said = {"role": escape_role(role, self.delimiter(part)), "text": escape(text)}
        return _FIELD.sub(lambda m: said[m[1]], self.parts[part][0])

    def pattern(self, part: int) -> re.Pattern[str]:
        """What reads a part again; a placeholder that comes twice has to say the same."""
        seen: set[str] = set()
        out = ""
        for bit in re.split(r"(\{role\}|\{text\})", self.parts[part][0]):
            name = bit[1:-1] if bit in ("{role}", "{text}") else ""
            out += re.escape(bit) if not name else f"(?P={name})" if name in seen else f"(?P<{name}>.*?)"
            seen |= {name} - {""}
        return re.compile(out, re.S)


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str, delimiter: str = "") -> str:
    role = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return role.replace(delimiter, f"\\u{ord(delimiter):06x}") if delimiter and delimiter != "\n" else role


def unescape_role(role: str) -> str:
    role = re.sub(r"(?<!\\)((?:\\\\)*)\\u([0-9a-f]{6})", lambda m: m[1] + chr(int(m[2], 16)), role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, position, text, loss, valid: the segments of each conversation, in order within their partition."""
    small_batches(turns.sparkSession)
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), *(F.coalesce(turns[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, position = object(), "", True, 0
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if c != conv:
                    conv, state, valid, position = c, "", True, 0
                valid = valid and role in template.order.get(state, ())
                state = role
                for part, (_, loss) in enumerate(template.parts):
                    out.append((c, position, template.rendered(part, role, text), loss and role in template.trained, valid))
                    position += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "position", "text", "loss", "valid"])

    return rows.mapInArrow(run, "conv_id long, position long, text string, loss boolean, valid boolean")


class Reader:
    """Reads the formatted segments of one conversation by its template, one after the other; holds one turn at most."""

    def __init__(self, template: Template = CHATML) -> None:
        self.template, self.patterns = template, [template.pattern(i) for i in range(len(template.parts))]
        self.at, self.found = 0, {}
        self.turns, self.chars, self.loss_chars, self.valid, self.last = 0, 0, 0, True, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: bool, valid: bool) -> None:
        self.chars += len(segment)
        self.valid = self.valid and valid
        read = self.patterns[self.at].fullmatch(segment)
        if read is None:
            raise ValueError("not a formatted turn")
        for name, said in read.groupdict().items():
            plain = unescape_role(said) if name == "role" else unescape(said)
            if self.found.setdefault(name, plain) != plain:
                raise ValueError(f"a turn says its {name} in two ways")
        if self.template.rendered(self.at, self.found.get("role", ""), self.found.get("text", "")) != segment:
            raise ValueError("not a formatted turn")  # a control string inside a text, say
        if loss:
            plain = unescape(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.at += 1
        if self.at == len(self.patterns):
            self.last = self.found["role"]
            self.all.update(f"{self.last}\n{self.found['text']}\n".encode("utf-8", "surrogatepass"))
            self.turns, self.at, self.found = self.turns + 1, 0, {}

    def row(self, final: tuple[str, ...]) -> tuple:
        if self.at:
            raise ValueError("a turn is not closed")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in final


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parse segments into a row per conversation. They have to be grouped and ordered as `segments` leaves them; if a
    conversation's segments aren't together and in order, an error says so."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    final = template.final

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, place = None, None, 0
        for batch in batches:
            out = []
            for c, at, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(5))):
                place = place + 1 if reader is not None and c == conv else 0
                if at != place:
                    raise ValueError(f"segment {at} of conversation {c} isn't where it belongs: sort by conv_id and position within partitions by conv_id")
                if reader is None or c != conv:
                    if reader is not None:
                        out.append((conv, *reader.row(final)))
                    conv, reader = c, Reader(template)
                reader.feed(text, loss, valid)
            yield made(out)
        if reader is not None:
            yield made([(conv, *reader.row(final))])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
