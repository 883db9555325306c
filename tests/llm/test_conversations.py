"""Conversation repair against an enumeration of all edits and a plain dynamic program."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from notelab.llm import conversations as C  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, conv string, live string, again string"
PATTERN = re.compile(r"(s?(ua)+)?$")
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    """{conv_id: after-damage rows (turn, role, text)} in their order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(WS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "none" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def counts(rows):
    found, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal)


def enumerated(rows):
    """(cost, audit, lines) over every edit with up to two inserts in a place."""
    best = None
    inserts = [(), *[(x,) for x in ("user", "assistant")], *itertools.product(("user", "assistant"), repeat=2)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for actions in itertools.product("DK12", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for i, g in enumerate(gaps):
                cost, audit, lines = cost + 2 * len(g), audit + "I" * len(g), lines + [f"{r}:" for r in g]
                if i == len(rows):
                    break
                (_, role, text), fault, act = rows[i], faults(rows)[i], actions[i]
                if act == "D":
                    cost, audit = cost + 3, audit + "D"
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += (fault == "truncated") + (act != "K") * 2
                audit += "K" if act == "K" else "R"
                lines = [*lines, f"{role if act == 'K' else 'user' if act == '1' else 'assistant'}:{text}"]
            else:
                continue
            if i == len(rows) and PATTERN.fullmatch("".join(x[:1] if x[:1] in ("s", "u", "a") else "-" for x in lines)):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def programmed(rows):
    """(cost, audit, lines) by a dynamic program over the pattern's states that keeps whole audits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(now):
        for _ in range(3):
            for s, (c, a, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    if (s, role[0]) in step:
                        new = (c + 2, a + "I", [*lines, role + ":"])
                        t = step[s, role[0]]
                        now[t] = min(now.get(t, new), new)
        return now

    now = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for s, (c, a, lines) in now.items():
            new[s] = min(new.get(s, (c + 3, a + "D", lines)), (c + 3, a + "D", lines))
        if fault in ("none", "truncated"):
            for s, (c, a, lines) in inserted(dict(now)).items():
                for letter, own in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (s, own[:1]) in step:
                        made = (c + (fault == "truncated") + 2 * (letter == "R"), a + letter, [*lines, f"{own}:{text}"])
                        t = step[s, own[:1]]
                        new[t] = min(new.get(t, made), made)
        now = new
    return min(v for s, v in inserted(now).items() if s in ("", "a"))


def wanted(rows, solve):
    out = {}
    for conv, kept in damage(rows).items():
        cost, audit, lines = solve(kept) if kept else (0, "", [])
        out[conv] = (*(counts(kept) if kept else (0,) * 5), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def repaired(spark, rows, **limits):
    got = C.repair(C.damaged(table(spark, rows)), **limits)
    assert got.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {None if r[0] is None else int(r[0]): r[1:] for r in found}


def some(seed, convs, longest, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(r.randrange(longest + 1)):
            out.append((c, None if r.random() < 0.05 else t // 2 if r.random() < 0.1 else t, r.choice(roles),
                        r.choice(["yes.", "no!", "cut", "why?", "", " \t\n", None, "a. ", "same.", "é…", f"t{r.randrange(99)}."])))
    return out


def test_every_edit_of_short_conversations(spark):
    rows = some(1, 60, 2) + [(100, 0, "assistant", "Hi."), (101, 0, "system", "Be good."), (102, 0, "user", "a."), (102, 1, "user", "b."), (103, 0, "system", "x"), (103, 1, "system", "y.")]
    assert repaired(spark, rows) == wanted(rows, enumerated)


@pytest.mark.parametrize("limits", [{}, {"held_rows": 3, "chunk": 2}, {"held_chars": 20, "chunk": 1000}])
def test_long_conversations_and_spilled_choices(spark, limits):
    rows = some(2, 40, 40) + [(None, t, r, x) for t, (r, x) in enumerate([("user", "a."), ("assistant", "b"), (None, None), ("user", "a.")])] + [(None, None, "user", "a.")]
    assert repaired(spark, rows, **limits) == wanted(rows, programmed)


def test_one_long_conversation_over_many_batches(spark):
    rows = [(7, t, ["user", "assistant"][t % 2] if t % 5 else "system", f"line {t % 900}" + "." * (t % 3)) for t in range(6000)]
    assert repaired(spark, rows, held_rows=500, chunk=700) == wanted(rows, programmed)


def test_states_stay_few():
    moves, r, vector = C.Moves(), random.Random(3), 0
    for _ in range(20_000):
        vector = moves(vector, r.randrange(4) * 4 + r.randrange(4))[0]
    assert len(moves.vectors) < 500


def test_nothing(spark):
    assert repaired(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "x")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
