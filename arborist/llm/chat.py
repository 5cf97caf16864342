"""Chat formatting with minimum-cost role repair.

Legal conversations are those of an automaton: at most one system message, first; then user and assistant in turn,
ending with the assistant. Dynamic programming over its states chooses, for every turn, whether to keep it, relabel
it, merge it into the message before it, or insert empty messages in front of it, at the least total cost.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks. A first pass
returns cost matrices of the pieces at the partitions' edges (a few numbers a partition); the driver joins them and
fixes the states at the edges, and a second pass repairs every piece on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import cut

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Messages that may follow a state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: merging two messages, relabelling a known or an unknown role, inserting an empty message.
MERGE, RELABEL, GUESS, INSERT = 1, 2, 1, 3
#: Other names of the roles; anything else is unknown.
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT} | {
    r: k for k, r in enumerate(ROLES) if r
}
INF = 10**9
#: The markers of a rendered message; in texts they are broken up by a space.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def role_of(name: str | None) -> int:
    """State of a role's name; 0 if it is unknown."""
    return ALIASES.get((name or "").strip().lower(), 0)


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of inserted messages from one state to another."""
    found: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, p), run in list(found.items()):
            for q in NEXT[p]:
                if len(run) + 1 < len(found.get((s, q), (0,) * 9)):
                    found[s, q] = (*run, q)
    return found


_RUNS = _inserts()


def _relabel(role: int, to: int) -> int:
    return 0 if role == to else RELABEL if role else GUESS


def options(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(cost, state before, state after, action, inserted messages) of everything that can be done with a turn."""
    found = []
    for s in range(4):
        if s:
            found.append((MERGE + _relabel(role, s), s, s, "merge", ()))
        for (a, p), run in _RUNS.items():
            if a == s:
                for q in NEXT[p]:
                    cost = INSERT * len(run) + _relabel(role, q)
                    found.append((cost, s, q, "keep" if role == q else "relabel", run))
    return sorted(found, key=lambda x: (x[0], len(x[4]), x[3] == "merge", x[1], x[2]))


OPTIONS = [options(r) for r in range(4)]
#: Cost of ending in a state, and the messages inserted for it.
ENDS = {START: (0, ())} | {s: (INSERT * len(_RUNS[s, ASSISTANT]), _RUNS[s, ASSISTANT]) for s in (SYSTEM, USER, ASSISTANT)}


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost of a run of turns from each state to each state."""
    rows = []
    for start in range(4):
        cost = [INF] * 4
        cost[start] = 0
        for r in roles:
            new = [INF] * 4
            for c, s, q, _, _ in OPTIONS[r]:
                if cost[s] + c < new[q]:
                    new[q] = cost[s] + c
            cost = new
        rows.append(cost)
    return rows


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> list[tuple]:
    """The best option of each turn, from state entry; into state leave, or to a legal end where it is None."""
    cost, back = [INF] * 4, []
    cost[entry] = 0
    for r in roles:
        new, step = [INF] * 4, [None] * 4
        for option in OPTIONS[r]:
            c = cost[option[1]] + option[0]
            if c < new[option[2]]:
                new[option[2]], step[option[2]] = c, option
        cost = new
        back.append(step)
    state = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + ENDS[s][0], s))
    chosen = []
    for step in reversed(back):
        chosen.append(step[state])
        state = step[state][1]
    return chosen[::-1]


def _edges(parts: list[tuple[int, list[tuple[str, list[list[int]]]]]]) -> dict[int, tuple[int, int | None]]:
    """(entry state, leaving state) of the partitions that a conversation enters or leaves.

    parts: for each partition with rows, in order, the first and the last conversation's key and matrix (one entry if
    there is only one conversation).
    """
    entry: dict[int, int] = {}
    leave: dict[int, int] = {}
    chain: list[tuple[int, list[list[int]]]] = []

    def close() -> None:
        if len(chain) < 2:
            return
        costs, steps = [0, INF, INF, INF], []
        for _, m in chain:
            best = [min(range(4), key=lambda s: (costs[s] + m[s][q], s)) for q in range(4)]
            costs = [costs[best[q]] + m[best[q]][q] for q in range(4)]
            steps.append(best)
        state = min(range(4), key=lambda s: (costs[s] + ENDS[s][0], s))
        for (p, _), best in zip(reversed(chain), reversed(steps), strict=True):
            if p != chain[-1][0]:
                leave[p] = state
            state = best[state]
            if p != chain[0][0]:
                entry[p] = state
        return

    last = None
    for p, ends in parts:
        if last is not None and ends[0][0] == last:
            chain.append((p, ends[0][1]))
        else:
            close()
            chain = [(p, ends[0][1])]
        if len(ends) > 1:
            close()
            chain = [(p, ends[1][1])]
        last = ends[-1][0]
    close()
    return {p: (entry.get(p, START), leave.get(p)) for p in entry.keys() | leave.keys()}


def _safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, tie, row, place, role, action, cost, rendered): one row a turn and one an inserted message.

    Rows in order of conversation, turn, tie, row and place (below 0: inserted before the turn, 0: the turn, above: inserted
    after the last turn) render to the conversation when their texts are joined. Turns of equal number are ordered by
    a hash of role and text (tie), repeated ones by their place in the input (row); a null turn comes first; turns of a null conversation are one conversation; a null or
    unknown role takes the cheapest role; a null text is empty.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
        F.xxhash64(role_col, text_col).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "tie", "row"]
    rows = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []  # first and last conversation: key, product of matrices
        for batch in batches:
            keys, names = (batch.column(k).to_pylist() for k in range(2))
            for key, group in groupby(zip(map(repr, keys), names, strict=True), key=lambda x: x[0]):
                m = matrix([role_of(name) for _, name in group])
                if found and found[-1][0] == key:
                    old = found[-1][1]
                    found[-1][1] = [[min(old[s][k] + m[k][q] for k in range(4)) for q in range(4)] for s in range(4)]
                else:
                    found[1:] = [[key, m]] if found else []
                    found = found or [[key, m]]
        p = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p] * len(found), pa.int32()), pa.array([k for k, _ in found], pa.string()),
                pa.array([[min(x, INF) for r in m for x in r] for _, m in found], pa.list_(pa.int64())),
            ],
            names=["part", "conv", "costs"],
        )

    edge: dict[int, list] = {}
    for r in rows.select("conv", "role").mapInArrow(ends, "part int, conv string, costs array<bigint>").collect():
        edge.setdefault(r.part, []).append((r.conv, [list(r.costs[4 * k : 4 * k + 4]) for k in range(4)]))
    states = spark.sparkContext.broadcast(_edges(sorted(edge.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, leave = states.value.get(TaskContext.get().partitionId(), (START, None))

        def piece(held: pa.Table, entry: int, leave: int | None) -> pa.Table:
            roles = [role_of(x) for x in held.column(4).to_pylist()]
            texts = held.column(5).to_pylist()
            chosen = repair(roles, entry, leave)
            at, place, role, action, cost, out = [], [], [], [], [], []

            def message(k: int, where: int, state: int, did: str, paid: int, text: str) -> None:
                at.append(k)
                place.append(where)
                role.append(ROLES[state])
                action.append(did)
                cost.append(paid)
                out.append(text)

            begun = entry != START
            for k, (paid, _, state, did, run) in enumerate(chosen):
                for j, s in enumerate(run):
                    message(k, j - len(run), s, "insert", INSERT, (CLOSE + "\n") * begun + f"{OPEN}{ROLES[s]}\n")
                    begun = True
                head = "\n\n" if did == "merge" else (CLOSE + "\n") * begun + f"{OPEN}{ROLES[state]}\n"
                message(k, 0, state, did, paid - INSERT * len(run), head + _safe(texts[k]))
                begun = True
            if leave is None:
                for j, s in enumerate(ENDS[chosen[-1][2]][1]):
                    message(len(chosen) - 1, j + 1, s, "insert", INSERT, f"{CLOSE}\n{OPEN}{ROLES[s]}\n")
                out[-1] += CLOSE + "\n"
            rows = held.select([0, 1, 2, 3]).take(pa.array(at, pa.int64()))
            for name, values, kind in (
                ("place", place, pa.int32()), ("role", role, pa.string()), ("action", action, pa.string()),
                ("cost", cost, pa.int32()), ("rendered", out, pa.string()),
            ):
                rows = rows.append_column(name, pa.array(values, kind))
            return rows

        held: list[pa.RecordBatch] = []
        key = first = None
        for batch in batches:
            keys, at = [repr(x) for x in batch.column(0).to_pylist()], 0
            for k, group in groupby(keys):
                n = len(list(group))
                if key is not None and k != key:
                    yield from piece(pa.Table.from_batches(held), entry if key == first else START, None).to_batches()
                    held = []
                first = first or k
                key = k
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield from piece(pa.Table.from_batches(held), entry if key == first else START, leave).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("conv", "turn", "tie", "row", "role", "text").mapInArrow(
        run, f"conv_id {kinds['conv']}, turn {kinds['turn']}, tie bigint, row bigint, place int, role string, action string, cost int, rendered string"
    )


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, text, cost) of repaired conversations, each in one row: for conversations that fit a row."""
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "tie", "row", "place", "rendered"))).alias("parts"), F.sum("cost").alias("cost"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), "cost")
