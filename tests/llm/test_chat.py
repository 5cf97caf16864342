import itertools
import random
import re

import pytest

from arborist.llm import chat


def legal(states):
    at = chat.START
    for s in states:
        if s not in chat.NEXT[at]:
            return False
        at = s
    return at in (chat.START, chat.ASSISTANT)


def cheapest(roles):
    """Least cost by trying every labelling, every merge and every number of insertions up to two before each turn."""
    best = chat.INF
    empties = [(), *[(a,) for a in (1, 2, 3)], *itertools.product((1, 2, 3), repeat=2)]
    n = len(roles)

    def go(k, states, cost):
        nonlocal best
        if cost >= best:
            return
        if k == n:
            for run in empties:
                if legal([*states, *run]):
                    best = min(best, cost + chat.INSERT * len(run))
            return
        if states:
            go(k + 1, states, cost + chat.MERGE + chat._relabel(roles[k], states[-1]))
        for run in empties:
            for q in (1, 2, 3):
                new = [*states, *run, q]
                at = chat.START
                for s in new:
                    if s not in chat.NEXT[at]:
                        break
                    at = s
                else:
                    go(k + 1, new, cost + chat.INSERT * len(run) + chat._relabel(roles[k], q))

    go(0, [], 0)
    return best


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repair_is_cheapest(n):
    for roles in itertools.product(range(4), repeat=n):
        chosen = chat.repair(list(roles))
        states = []
        for _, _, q, did, run in chosen:
            states += [*run, *([] if did == "merge" else [q])]
        end = chat.ENDS[chosen[-1][2]]
        assert legal([*states, *end[1]])
        assert sum(x[0] for x in chosen) + end[0] == cheapest(list(roles)), roles


def parsed(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def test_conversations_over_many_partitions(spark):
    rnd = random.Random(5)
    rows, names = [], ["user", "assistant", "system", "human", "GPT ", None, "odd"]
    for c in range(60):
        rows += [(c, t, rnd.choice(names), f"c{c}t{t}") for t in range(rnd.randrange(1, 9))]
    rows += [(77, t, rnd.choice(names), f"c77t{t}") for t in range(400)]  # spans partitions
    rows += [(None, 0, "user", "n <|im_end|> n"), (78, None, "user", None), (78, 1, "assistant", ""), (79, 0, "user", "twice"), (79, 0, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = turns.withColumn("place", chat.F.lit(1))
    found = {r.conv_id: r for r in chat.render(chat.repaired(turns)).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, r in found.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1]))
        roles = [chat.role_of(x[2]) for x in mine]
        chosen = chat.repair(roles)
        assert r.cost == sum(x[0] for x in chosen) + chat.ENDS[chosen[-1][2]][0]
        messages = parsed(r.text)
        assert "".join(f"{chat.OPEN}{a}\n{b}{chat.CLOSE}\n" for a, b in messages) == r.text
        assert legal([chat.ROLES.index(a) for a, _ in messages])
        said = [t for _, b in messages for t in b.split("\n\n") if t]
        assert said == [(x[3] or "").replace("<|im_", "<| im_") for x in mine if x[3]]
    assert chat.repaired(turns.limit(0)).count() == 0
