"""Chat formatting: a declarative template, run by a finite-state machine over roles.

Rows are dealt by conversation and sorted by turn; a task walks them one after another and keeps
only the machine's state, so a conversation of any length passes through bounded memory. Out
come segments: pieces of the formatted text, each with its loss flag.
"""

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are marked, which of them carry loss, and which orders are valid.

    ``other`` marks roles without a turn of their own: ``before`` then the role, ``between``,
    the text, ``after``. ``moves`` maps a state and a role to the next state; a conversation is
    valid if every turn has a move and the last state accepts.
    """

    begin: str
    turns: dict[str, Turn]
    other: tuple[str, str, str]
    moves: dict[str, dict[str, str]]
    accepts: frozenset[str]
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for control in self.controls:
            if len(control) < 2 or control[1] == ESCAPE:
                raise ValueError(f"a control string can't be escaped: {control!r}")


# Markers of a common instruction template.
INSTRUCTION = Template(
    begin="<s>",
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", "</s>", loss=True),
    },
    other=("<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    moves={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    accepts=frozenset({"asked", "answered"}),
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
)


def escape(text: str, controls: tuple[str, ...]) -> str:
    """``text`` without a control string: an escape follows the first character of each."""
    starts = "|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True))
    return re.sub(rf"(?=(?:{starts}))(.)", rf"\1{ESCAPE * 2}", text.replace(ESCAPE, ESCAPE * 2), flags=re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


_SEGMENTS = "conv_id bigint, part bigint, kind string, segment string, loss boolean, fault string"


def format_chat(conversations: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Segments of every conversation: ``conv_id``, ``part``, ``kind``, ``segment``, ``loss``, ``fault``.

    ``conversations`` has conv_id, turn, role, text. Joined in order of ``part`` (kinds begin,
    mark, text) the segments are the formatted conversation; ``loss`` marks the texts to learn.
    Invalid turn orders are formatted all the same: the last row, of kind end, names the first
    turn without a move or an unfinished end in ``fault`` (null if valid). Null text or role is
    empty; rows with equal turns follow each other by role and text, null turns come first; a
    null conv_id is a conversation of its own. Segments leave in order, dealt by conversation.
    """
    plain = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    begin, turns, other = template.begin, template.turns, template.other
    moves, accepts, controls = template.moves, template.accepts, template.controls

    def segments(batches):
        current, part, state, fault = None, 0, "start", None

        def end(out):
            out.append((current[0], part, "end", "", False, fault or (None if state in accepts else f"ends {state}")))

        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current is None or current[0] != conv:
                    if current is not None:
                        end(out)
                    current, part, state, fault = (conv,), 0, "start", None
                    pieces = [("begin", begin, False)]
                else:
                    pieces = []
                state = moves.get(state, {}).get(role, "lost")
                if state == "lost" and fault is None:
                    fault = f"turn {turn}: {role}"
                body = escape(text, controls)
                if role in turns:
                    how = turns[role]
                    pieces += [("mark", how.before, False), ("text", body, how.loss), ("mark", how.after, False)]
                else:
                    opened = other[0] + escape(role, controls) + other[1]
                    pieces += [("mark", opened, False), ("text", body, False), ("mark", other[2], False)]
                for kind, piece, loss in pieces:
                    out.append((conv, part, kind, piece, loss, None))
                    part += 1
            yield _batch(out)
        if current is not None:
            out = []
            end(out)
            yield _batch(out)

    def _batch(out):
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        names = ["conv_id", "part", "kind", "segment", "loss", "fault"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return dealt.mapInArrow(segments, _SEGMENTS)


def read_turns(segments: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Digests of each conversation, read back from its formatted text.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line end, text, line end per turn),
    ``loss_chars``, ``loss_sha256`` (texts under the loss mask, unescaped), ``formatted_chars``,
    ``fault``. The text is parsed by the template's markers alone; ``kind`` is not looked at
    except to see a conversation's end. Only the turn being read is held.
    """
    begin, turns, other = template.begin, template.turns, template.other

    def opening(text: str):
        """Role, its mark's length and closing mark of the turn that ``text`` starts with."""
        for role, how in turns.items():
            if text.startswith(how.before):
                return role, len(how.before), how.after
        if text.startswith(other[0]) and other[1] in text:
            at = text.index(other[1])
            return unescape(text[len(other[0]) : at]), at + len(other[1]), other[2]
        return None

    def digests(batches):
        def fresh():
            return {"held": "", "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "opened": False}

        state = fresh()
        for batch in batches:
            out = []
            for conv, kind, piece, loss, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == "end":
                    if state["held"]:
                        raise ValueError(f"conversation {conv}: text that no marker closes")
                    out.append((conv, state["n"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], fault))
                    state = fresh()
                    continue
                state["chars"] += len(piece)
                if loss:
                    said = unescape(piece)
                    state["loss"].update(said.encode())
                    state["loss_chars"] += len(said)
                state["held"] += piece
                if not state["opened"] and state["held"].startswith(begin):
                    state["held"], state["opened"] = state["held"][len(begin) :], True
                found = opening(state["held"])
                if found and (at := state["held"].find(found[2], found[1])) >= 0 and piece == found[2]:
                    role, start, close = found
                    text = unescape(state["held"][start:at])
                    state["all"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                    state["held"] = state["held"][at + len(close) :]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    # Formatting keeps a conversation's segments in order in one task; nothing is moved.
    return segments.select("conv_id", "kind", "segment", "loss", "fault").mapInArrow(
        digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, fault string",
    )
