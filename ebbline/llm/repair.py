"""Conversation structure repair: a generalised LR parser over roles with weighted edits.

The grammar of valid role orders is data; its LR automaton is made from it. Parsing a
conversation keeps all stacks at once: their tops form the front of a graph whose nodes share
what lies below. Each row is kept, given another role or deleted, turns may be inserted before
it, and tops that meet are merged into the one of least (cost, edits). What all fronts agree on is
final and leaves at once, so only the undecided end of a conversation is held.
"""

import os.path
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space, sentence ends, the pairs of roles that may follow each other.
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
PAIRS = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")

# A conversation is empty, or pairs of user and assistant with a system turn first
# or none. Capitals are symbols, small letters the initials of roles.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
MADE_ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """Weights of the edits; ``cut`` is added for a truncated row that isn't deleted."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    cut: int = 1


class Automaton:
    """LR item sets of a grammar, and what a stack becomes when a symbol is read.

    A stack is (state, stack below) down to None: stacks share their lower parts. A state that
    ends a rule other than the start symbol's is reduced at once.
    """

    def __init__(self, grammar=GRAMMAR):
        self.grammar, self.start = grammar, grammar[0][0]
        self.first = (self._closed((r, 0) for r, (left, _) in enumerate(grammar) if left == self.start), None)
        self.known: dict[tuple, tuple | None] = {}

    def _closed(self, items) -> frozenset:
        found = set(items)
        while True:
            wanted = {self.grammar[r][1][d] for r, d in found if d < len(self.grammar[r][1])}
            more = {(r, 0) for r, (left, _) in enumerate(self.grammar) if left in wanted}
            if more <= found:
                return frozenset(found)
            found |= more

    def _pushed(self, stack: tuple, symbol: str) -> tuple | None:
        moved = [(r, d + 1) for r, d in stack[0] if self.grammar[r][1][d : d + 1] == symbol]
        return (self._closed(moved), stack) if moved else None

    def read(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack after ``symbol`` and all reductions, None if it can't follow."""
        if (stack, symbol) not in self.known:
            at = self._pushed(stack, symbol)
            while at and (ended := self._ended(at[0])):
                left, right = self.grammar[ended[0]]
                for _ in right:
                    at = at[1]
                at = self._pushed(at, left)
            self.known[stack, symbol] = at
        return self.known[stack, symbol]

    def _ended(self, state: frozenset) -> list[int]:
        return [r for r, d in state if d == len(self.grammar[r][1]) and self.grammar[r][0] != self.start]

    def accepts(self, stack: tuple) -> bool:
        return any(self.grammar[r][0] == self.start and d == len(self.grammar[r][1]) for r, d in stack[0])


class Repair:
    """The cheapest edits of one conversation, read row by row.

    ``tops`` maps a stack's top state to (cost, edits not yet final, stack). Merging by top is
    safe as what may follow depends on the top alone in this grammar, and as of two edit lists of
    equal cost for the same rows neither starts with the other.
    """

    #: Rows held before what is agreed on is looked for, and how often again.
    EVERY = 64

    def __init__(self, automaton: Automaton, costs: Costs):
        self.automaton, self.costs = automaton, costs
        self.tops = {automaton.first[0]: (0, "", automaton.first)}
        self.held: list[tuple] = []
        self.last, self.look_at = "", self.EVERY

    def _add(self, tops: dict, cost: int, edits: str, stack: tuple | None) -> bool:
        if stack is None or (stack[0] in tops and tops[stack[0]][:2] <= (cost, edits)):
            return False
        tops[stack[0]] = (cost, edits, stack)
        return True

    def _insert(self) -> None:
        front = list(self.tops.values())
        while front:
            found = []
            for cost, edits, stack in front:
                for initial in MADE_ROLES:
                    more = (cost + self.costs.insert, edits + "I", self.automaton.read(stack, initial))
                    if self._add(self.tops, *more):
                        found.append(more)
            front = found

    def row(self, role: str, text: str, fault: str | None) -> list[tuple]:
        """Read a row; returns the edits that became final."""
        self._insert()
        read, costs = self.automaton.read, self.costs
        cut = costs.cut if fault == "truncated" else 0
        tops: dict = {}
        for cost, edits, stack in self.tops.values():
            self._add(tops, cost + costs.delete, edits + "D", stack)
            if fault in (None, "truncated"):
                if role:
                    self._add(tops, cost + cut, edits + "K", read(stack, role[0]))
                for initial in MADE_ROLES:
                    self._add(tops, cost + costs.rerole + cut, edits + "R", read(stack, initial))
        # The cheapest top can come to any other's place by two inserts, and delete a system turn
        # that only the start could keep: what costs more than that beyond it never wins.
        least = min(top[0] for top in tops.values()) + self.costs.delete + 2 * self.costs.insert
        self.tops = {state: top for state, top in tops.items() if top[0] <= least}
        self.held.append((role, text, fault))
        if len(self.held) < self.look_at:
            return []
        shared = os.path.commonprefix([edits for _, edits, _ in tops.values()])
        self.tops = {state: (cost, edits[len(shared) :], stack) for state, (cost, edits, stack) in tops.items()}
        out = self._final(shared)
        self.look_at = len(self.held) + max(self.EVERY, len(self.held))
        return out

    def end(self) -> tuple[int, list[tuple]]:
        """The least cost and the rest of the edits."""
        self._insert()
        cost, edits, _ = min(t for t in self.tops.values() if self.automaton.accepts(t[2]))
        return cost, self._final(edits)

    def _final(self, edits: str) -> list[tuple]:
        out, used = [], 0
        for edit in edits:
            role, text, fault = ("", "", None) if edit == "I" else self.held[used]
            used += edit != "I"
            if edit in "IR":
                role = MADE_ROLES["a" if self.last == "u" else "u"]
            if edit != "D":
                self.last = role[0]
            out.append((edit, role, text, fault))
        del self.held[:used]
        return out


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``fault``: a row's first fault, null if sound.

    Blank: nothing but white space. Duplicate: the conversation has the same role and text in an
    earlier row. Truncated: the last character but white space ends no sentence. Rows come out
    dealt by conversation, ordered by turn (null first), role and text.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    same = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("turn")
    fault = (
        F.when(body == "", FAULTS[0])
        .when(F.col("seen") > 1, FAULTS[1])
        .when(~F.substring(body, -1, 1).isin(*ENDS), FAULTS[2])
    )
    # Dealt once: sorting for the window and for the order moves no row again.
    seen = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same))
    ordered = seen.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", "seen")
    return ordered.select("conv_id", "turn", "role", "text", "fault")


_EDITS = "conv_id bigint, part bigint, edit string, role string, text string, fault string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _plain(name: str, kind: str, null: Column) -> Column:
    return F.coalesce(F.col(name).cast(kind), null).alias(name)


def repair_conversations(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Edits that give every conversation a valid order of roles at the least cost.

    ``conversations`` has conv_id, turn, role, text. Out comes a row per edit in order of ``part``:
    ``edit`` is K (kept), R (other role), D (deleted) or I (inserted, empty text), ``role`` and
    ``text`` those after it (of a deleted row, its own), ``fault`` the row's own. A conversation's
    last row has a null edit and its ``cost``, ``gaps`` (turns missing between the smallest and
    the largest), counts of its faults and of adjacent roles out of order (``illegal``). Joined,
    the rows that aren't deleted are the repaired conversation.

    Blank and repeated rows must go. Of edits of equal cost those first in ASCII order are taken.
    Null role or text is one space, hence no valid role and blank; rows of equal turn follow each
    other by role and text, null turns come first and count for no gap; rows of a null conv_id
    are one conversation. Other columns aren't looked at; an empty table gives an empty result.
    A conversation is read in one task, streamed: rows of any number pass through bounded memory
    as long as the fronts come to agree.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _plain("role", "string", space),
        _plain("text", "string", space),
    )

    def edits(batches):
        automaton = Automaton()
        current = None

        def fresh(conv):
            return {"conv": conv, "repair": Repair(automaton, costs), "part": 0, "turns": 0, "low": None, "high": None, "before": None, "illegal": 0, **dict.fromkeys(FAULTS, 0)}

        def add(out, done):
            for edit, role, text, fault in done:
                out.append((current["conv"], current["part"], edit, role, text, fault, *[None] * 6))
                current["part"] += 1

        def end(out):
            cost, done = current["repair"].end()
            add(out, done)
            gaps = current["high"] - current["low"] + 1 - current["turns"] if current["turns"] else 0
            counts = [current[f] for f in FAULTS]
            out.append((current["conv"], current["part"], None, None, None, None, gaps, *counts, current["illegal"], cost))

        for batch in batches:
            out = []
            for conv, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if current is None or current["conv"] != conv:
                    if current is not None:
                        end(out)
                    current = fresh(conv)
                if turn is not None and turn != current["high"]:
                    current["low"] = turn if current["low"] is None else current["low"]
                    current["high"] = turn
                    current["turns"] += 1
                if current["before"] is not None and current["before"] + role[:1] not in PAIRS:
                    current["illegal"] += 1
                current["before"] = role[:1]
                if fault:
                    current[fault] += 1
                add(out, current["repair"].row(role, text, fault))
            yield _batch(out)
        if current is not None:
            out = []
            end(out)
            yield _batch(out)

    return with_faults(rows).mapInArrow(edits, _EDITS)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in _EDITS.split(",")]
    columns = list(zip(*out)) or [()] * len(fields)
    kinds = [pa.int64() if kind == "bigint" else pa.string() for _, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [name for name, _ in fields])


def summarise(edits: DataFrame) -> DataFrame:
    """A row per conversation: its counts, ``cost``, ``audit`` (all edits' letters) and
    ``repaired_sha256`` (of ``role:text`` lines, joined by line ends), read from the edits.

    Takes the result of ``repair_conversations`` as it is: edits in order, dealt by conversation.
    """
    import hashlib

    numbers = ["gaps", *FAULTS, "illegal", "cost"]
    schema = ", ".join(["conv_id bigint", *[f"{c} bigint" for c in numbers], "audit string, repaired_sha256 string"])

    def digests(batches):
        letters, text_hash, begun = [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for conv, edit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if edit is None:
                    out.append((conv, *counts, "".join(letters), text_hash.hexdigest()))
                    letters, text_hash, begun = [], hashlib.sha256(), False
                    continue
                letters.append(edit)
                if edit != "D":
                    text_hash.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
            columns = list(zip(*out)) or [()] * (len(numbers) + 3)
            kinds = [pa.int64()] * (len(numbers) + 1) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *numbers, "audit", "repaired_sha256"])

    return edits.select("conv_id", "edit", "role", "text", *numbers).mapInArrow(digests, schema)
