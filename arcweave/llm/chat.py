"""Chat conversations as training windows of a token budget.

A turn is rendered as a header (a mark, its role, a mark), its text and an end mark. The marks have ids of their own beyond
the vocabulary, so no text can forge them. With the prefix sums of the turns' tokens every window is a search: it holds the
system turns that open the conversation, then repeats the turns before its first new one as far as HISTORY_TURNS and
HISTORY_SHARE of the budget allow, then takes as many new turns as fit. Only what the assistant says in new turns (text and
end mark) is a target; repeated turns are masked, so every target counts once. Where the next turn doesn't fit beside
repeated ones, none are repeated; a turn longer than the room is cut into pieces, each a window, its header with the first.

The opening system turns stand whole in every window as long as they leave ROOM of the budget. Longer ones are given
whole in windows of their own, which come first; the other windows then keep as many of their first tokens as leave half
of the budget (system_whole is false), so that no token is lost.

Conversations are cut at every SEGMENT turns, so that one task never holds a conversation however long: a window's new
turns are of one segment, its repeated turns may be of the one before. Turns find their positions in a distributed sort.

Defined results. Turns come in order of turn, then role, then text; a null turn last, and repeated rows (ties) as often as
they stand. A null role is `unknown`, a null text empty (the turn is its header and end mark). Rows with a null conv_id are
left out. A conversation of system turns alone has windows without targets. Very long turns are cut into pieces, never
short. Other columns are not read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import separators, textnum, util
from arcweave.operators.extract import dense_ids

BUDGET = 1024
HISTORY_TURNS = 4
HISTORY_SHARE = 0.25
#: Share of the budget that the system turns must leave.
ROOM = 0.125
SEGMENT = 1024
#: Ids after the vocabulary's and the separator's: before a role, after a role, after a turn.
TURN, SAYS, END = (separators.SEPARATOR + k for k in (1, 2, 3))


class Window(NamedTuple):
    """Repeated turns begin:new, new turns new:end, and the part low:high of the one new turn where it is cut (else 0 and the
    size of the last turn)."""

    begin: int
    new: int
    end: int
    low: int
    high: int


def windows(sizes: list[int], at: int, room: int, budget: int = BUDGET, turns: int = HISTORY_TURNS, share: float = HISTORY_SHARE) -> list[Window]:
    """The windows of turns of those sizes, whose first new one is `at`; those before it may be repeated."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    while at < len(sizes):
        begin = max(at - turns, 0, int(np.searchsorted(sums, sums[at] - int(budget * share))))
        end = int(np.searchsorted(sums, sums[begin] + room, "right")) - 1
        if end <= at:
            begin, end = at, int(np.searchsorted(sums, sums[at] + room, "right")) - 1
        if end <= at:
            out += [Window(at, at, at + 1, i, min(i + room, sizes[at])) for i in range(0, sizes[at], room)]
            end = at + 1
        else:
            out.append(Window(begin, at, end, 0, sizes[end - 1]))
        at = end
    return out


def room_for(system: int, budget: int) -> tuple[int, int]:
    """(system tokens that a window keeps, tokens of other turns that it has room for)."""
    kept = system if system <= budget - max(1, int(budget * ROOM)) else budget // 2
    return kept, budget - kept


_KINDS = [("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("new_turn", pa.int64()), ("end_turn", pa.int64()), ("n_tokens", pa.int32()), ("n_targets", pa.int32()), ("system_whole", pa.bool_()), ("tokens", pa.list_(pa.int32())), ("targets", pa.list_(pa.int8()))]
_SCHEMA = "conv_id long, window long, first_turn long, new_turn long, end_turn long, n_tokens int, n_targets int, system_whole boolean, tokens array<int>, targets array<tinyint>"


def render(turns: list[tuple[str, list[int]]], role_ids) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and targets of (role, ids of its text)."""
    codes, aims = [], []
    for role, body in turns:
        head = [TURN, *role_ids(role), SAYS]
        codes.append(np.array([*head, *body, END], np.int32))
        aims.append(np.repeat(np.array([0, role == "assistant"], np.int8), [len(head), len(body) + 1]))
    return codes, aims


def conversation(lead: list, before: list, said: list, role_ids, base: int, budget: int, turns: int, share: float) -> Iterator[tuple]:
    """Rows (first turn, new turn, end turn, system whole, tokens, targets) of one segment whose first turn has position
    `base`; lead and before are the opening system turns and the turns before it, of other segments."""
    if not base:
        n = next((i for i, t in enumerate(said) if t[0] != "system"), len(said))
        lead, said, base = said[:n], said[n:], n
        first = True
    else:
        first = False
    system = np.concatenate([np.zeros(0, np.int32), *render(lead, role_ids)[0]])
    kept, room = room_for(len(system), budget)
    fits = kept == len(system)
    if first and (not fits or not said):  # the system turns by themselves
        for i in range(0, len(system), budget):
            part = system[i : i + budget]
            yield 0, 0, base, fits, part, np.zeros(len(part), np.int8)
    codes, aims = render(before + said, role_ids)
    shift = base - len(before)
    for w in windows([len(c) for c in codes], len(before), room, budget, turns, share):
        part = codes[w.begin : w.end]
        aim = [a if i >= w.new else np.zeros_like(a) for i, a in zip(range(w.begin, w.end), aims[w.begin : w.end])]
        if w.end - w.begin == 1:
            part, aim = [part[0][w.low : w.high]], [aim[0][w.low : w.high]]
        yield w.begin + shift, w.new + shift, w.end + shift, fits, np.concatenate([system[:kept], *part]), np.concatenate([np.zeros(kept, np.int8), *aim])


def _windows_of(budget: int, turns: int, share: float, segment: int, vocabulary: str):
    schema = pa.schema(_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = separators.encoding(vocabulary)
        roles: dict[str, list[int]] = {}

        def role_ids(role: str) -> list[int]:
            if role in roles:
                return roles[role]
            ids = enc.encode_ordinary(role)
            if len(roles) < 1000:
                roles[role] = ids
            return ids

        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            *plain, tokens, targets = zip(*rows)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (tokens, targets)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(plain, _KINDS)] + lists, schema=schema)

        for batch in batches:
            for at in range(batch.num_rows):
                conv, number, *parts = (batch.column(i)[at].as_py() for i in range(5))
                parts = [p or [] for p in parts]
                codes = iter(enc.encode_ordinary_batch([t["text"] for p in parts for t in p], num_threads=1))
                lead, before, said = ([(t["role"], next(codes)) for t in p] for p in parts)
                for k, (first, new, end, fits, tokens, targets) in enumerate(conversation(lead, before, said, role_ids, number * segment, budget, turns, share)):
                    rows.append((conv, number << 32 | k, first, new, end, len(tokens), int(targets.sum()), fits, tokens, targets))
                    held += len(tokens)
                    if held > 1 << 18:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()
        textnum.give_back()

    return run


def format_chats(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE, vocabulary: str = separators.VOCABULARY, segment: int = SEGMENT) -> DataFrame:
    """One row a window: (conv_id, window, first_turn, new_turn, end_turn, n_tokens, n_targets, system_whole, tokens,
    targets). Turns are positions in the conversation's order, end excluded; window orders a conversation's windows (the
    segment above 32 bits of number); targets has a 1 for each token that training predicts."""
    if history_turns > segment:
        raise ValueError("a segment holds at least the turns that are repeated")
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), text("role", "unknown"), text("text", ""))
    placed = dense_ids(rows, "conv_id", "last", "turn", "role", "text", name="place")
    begin = placed.groupBy("conv_id").agg(F.min("place").alias("begin"))
    placed = placed.join(begin, "conv_id").withColumn("at", F.col("place") - F.col("begin"))
    said = placed.groupBy("conv_id", F.expr(f"at div {segment}").alias("number")).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("said"))
    said = util.materialize(said.select("conv_id", "number", F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("said")), "segments")
    none = F.lit(None).cast(said.schema["said"].dataType)
    opening = F.expr("array_position(transform(said, t -> t.role = 'system'), false)")  # 0 where all are
    lead = said.where("number = 0").select("conv_id", F.slice("said", 1, F.when(opening == 0, F.size("said")).otherwise(opening - 1).cast("int")).alias("lead"))
    tail = said.where(F.size("said") == segment).select("conv_id", (F.col("number") + 1).alias("number"), F.slice("said", -max(1, history_turns), max(1, history_turns)).alias("before"), F.size("said").alias("of"))
    later = said.where("number > 0").join(tail, ["conv_id", "number"]).join(lead, "conv_id")
    later = later.withColumn("before", F.when(F.col("number") == 1, F.slice("before", F.lit(1) + F.greatest(F.lit(0), F.size("lead") - F.lit(segment - max(1, history_turns))), F.size("before"))).otherwise(F.col("before")))
    first = said.where("number = 0").select("conv_id", "number", none.alias("lead"), none.alias("before"), "said")
    return first.unionByName(later.select("conv_id", "number", "lead", "before", "said")).mapInArrow(_windows_of(budget, history_turns, history_share, segment, vocabulary), _SCHEMA)
