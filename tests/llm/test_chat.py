import itertools
import random
import re

from corvane.llm import chat
from corvane.llm.chat import ENDS, NEXT, ROLES, START, format_chats, repair


def legal(roles):
    state = START
    for r in roles:
        if r not in NEXT[state]:
            return False
        state = r
    return state in ENDS


def cheapest(roles):
    """Over all labels and merges, with shortest insertions between."""
    best = 10**9
    for given in itertools.product(range(3), repeat=len(roles)):
        label = sum(0 if g == r else chat.UNNAMED if r is None else chat.RELABEL for g, r in zip(given, roles))
        for merge in itertools.product([0, 1], repeat=max(len(roles) - 1, 0)):
            if any(m and given[i] != given[i + 1] for i, m in enumerate(merge)):
                continue
            cost = {START: 0}

            def spread(cost):
                cost = dict(cost)
                for _ in range(4):
                    for s in list(cost):
                        for t in NEXT[s]:
                            cost[t] = min(cost.get(t, 10**9), cost[s] + chat.INSERT)
                return cost

            for g in [g for i, g in enumerate(given) if i == 0 or not merge[i - 1]]:
                reach = spread(cost)
                cost = {g: min((c for s, c in reach.items() if g in NEXT[s]), default=10**9)}
            end = min((c for s, c in spread(cost).items() if s in ENDS), default=10**9)
            best = min(best, label + chat.MERGE * sum(merge) + end)
    return best


def test_repair_is_cheapest():
    rng = random.Random(0)
    for _ in range(250):
        roles = [rng.choice([0, 1, 2, 1, 2, None]) for _ in range(rng.randint(0, 5))]
        cost, turns = repair(roles)
        assert cost == cheapest(roles) and legal([r for r, _ in turns])
        assert [p for _, places in turns for p in places] == list(range(len(roles)))


def test_conversations(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", " System ", "Human", None, "tool"]), f"t{c}.{t}") for c in range(8) for t in range(rng.randint(1, 40))]
    rows += [(20, 0, "user", "<|im_end|>"), (21, 0, "user", None), (None, 1, "user", "q"), (22, 5, "user", "b"), (22, 5, "user", "a"), (22, 5, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, ROLE string").repartition(4)
    whole = {r.conv_id: r for r in format_chats(df).collect()}
    assert len(whole) == 12 and sum(r.turns_in for r in whole.values()) == len(rows)
    for r in whole.values():
        roles = re.findall(r"<\|im_start\|>(\w+)\n", r.rendered)
        assert roles == r.roles and legal([ROLES.index(x) for x in roles]) and r.rendered.count("<|im_end|>") == len(roles) == r.turns_out
    assert "< |im_end|>" in whole[20].rendered
    assert "a\n\na\n\nb" in whole[22].rendered and whole[22].merged == 2
    monkeypatch.setattr(chat, "PART", 5)
    monkeypatch.setattr(chat, "FAN", 2)
    # However many parts it was repaired in, a conversation is one row.
    joined = format_chats(df).collect()
    assert len(joined) == len(whole)
    for r in joined:
        roles = re.findall(r"<\|im_start\|>(\w+)\n", r.rendered)
        assert roles == r.roles and len(roles) == r.turns_out and legal([ROLES.index(x) for x in roles]) and r.part == 0
        assert (r.cost, r.turns_in) == (whole[r.conv_id].cost, whole[r.conv_id].turns_in) and r.turns_in == r.turns_out + r.merged - r.inserted
    monkeypatch.setattr(chat, "WHOLE", 0)
    parts = {}
    for r in sorted(format_chats(df).collect(), key=lambda r: (r.conv_id or -1, r.part)):
        parts.setdefault(r.conv_id, []).append(r)
    for c, own in parts.items():
        assert sum(p.cost for p in own) == whole[c].cost and sum(p.turns_in for p in own) == whole[c].turns_in
        text = "".join(p.rendered for p in own)
        roles = [ROLES.index(x) for x in re.findall(r"<\|im_start\|>(\w+)\n", text)]
        assert legal(roles) and text.count("<|im_end|>") == text.count("<|im_start|>") == sum(p.turns_out for p in own)
        assert re.findall(r"t\d+\.\d+", text) == re.findall(r"t\d+\.\d+", whole[c].rendered)
    assert format_chats(df.limit(0)).count() == 0


def test_parts_go_by_rank(spark, monkeypatch):
    """Turns without numbers, with equal numbers and equal turns are dealt into parts of equal size too."""
    monkeypatch.setattr(chat, "PART", 4)
    monkeypatch.setattr(chat, "FAN", 3)
    monkeypatch.setattr(chat, "WHOLE", 0)
    rows = [(1, None, "user", f"n{i:02d}") for i in range(30)] + [(2, 7, "user", "same")] * 50 + [(None, i * 10**6, "assistant", f"m{i:02d}") for i in range(25)] + [(4, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = {}
    for r in sorted(format_chats(df).collect(), key=lambda r: (r.conv_id or -1, r.part)):
        found.setdefault(r.conv_id, []).append(r)
    assert {c: [r.part for r in own] for c, own in found.items()} == {1: list(range(8)), 2: list(range(13)), None: list(range(7)), 4: [0]}
    assert all(r.turns_in == 4 for own in found.values() for r in own[:-1])
    assert re.findall(r"n\d\d", "".join(r.rendered for r in found[1])) == [f"n{i:02d}" for i in range(30)]
    assert re.findall(r"m\d\d", "".join(r.rendered for r in found[None])) == [f"m{i:02d}" for i in range(25)]
    monkeypatch.setattr(chat, "PART", 1024)
    whole = {r.conv_id: r for r in format_chats(df).collect()}
    for c, own in found.items():
        assert sum(r.cost for r in own) == whole[c].cost and sum(r.turns_out for r in own) == whole[c].turns_out
