"""Conversation repair against every sequence of edits, and its defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trellis.llm.repair import repair, written_out

ROWS = "conv_id long, turn long, role string, text string, place int, fault string, gone string"
SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))


def brute(rows):
    """All edits of every turn with up to two insertions in every gap; the cheapest, then least audit wins."""
    rows = damaged(rows)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    gap = [(2 * n, "I" * n, list(p)) for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    best = [(cost, audit, [(r, "") for r in said]) for cost, audit, said in gap]
    for (_, _, role, text), fault in zip(rows, faults):
        edits = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            edits += [(more, "K", [(role, text)]), *[(2 + more, "R", [(x, text)]) for x in ("user", "assistant")]]
        step = [(c + d + e, a + b + g, said + t + [(r, "") for r in u]) for c, a, said in best for d, b, t in edits for e, g, u in gap]
        # no beginning of a wrong order can become right
        best = [x for x in step if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in x[2])) and all(r for r, _ in x[2])]
    cost, audit, said = min(x for x in best if GOOD.fullmatch("".join(r[:1] for r, _ in x[2])))
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "sha": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    }


def answers(df):
    rows = repair(df).select("*", F.sha2(written_out(F.col("turns")), 256).alias("sha")).drop("turns").collect()
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}
    assert len(found) == len(rows)
    return found


def compare(spark, rows):
    got, convs = answers(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS)), {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert got == {c: brute(rs) for c, rs in convs.items()}


def test_every_edit_of_short_conversations(spark):
    r = random.Random(3)
    texts = ["Yes.", "No?", "well", " \t", "", None, "Go on! ", "é…", "same.", "same."]
    roles = ["user", "assistant", "system", None, "", "tool", "usher"]
    rows = [(c, r.choice([t, t, t, t + 1, None]), r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(texts)) for c in range(90) for t in range(r.randrange(1, 5))]
    compare(spark, rows)


def test_orders_of_roles(spark):
    roles = {"s": "system", "u": "user", "a": "assistant"}
    orders = ["".join(x) for n in range(1, 4) for x in itertools.product("sua", repeat=n)]
    # no digest of these turns damages them
    turns = {c: [t for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 > 4][: len(o)] for c, o in enumerate(orders)}
    compare(spark, [(c, t, roles[x], f"{x} {t}.") for c, o in enumerate(orders) for t, x in zip(turns[c], o)])


def test_defined_cases(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Dropped."), (None, None, None, None), (None, 2, "user", "A null id."), (7, 1, "user", "Ok."), (7, 1, "user", "Ok.")]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." + "long " * 3000) for t in range(4)]
    compare(spark, rows)
    none = answers(spark.createDataFrame([(gone, 0, "user", "Dropped.", 1, "x", "y")], ROWS))[gone]
    assert none == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "sha": hashlib.sha256(b"").hexdigest()}
    assert answers(spark.createDataFrame([], ROWS)) == {}


@pytest.mark.parametrize("turns", [2000])
def test_a_long_conversation(spark, turns):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(turns)]
    got = answers(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS))[1]
    n = len(damaged(rows))
    assert sum(x in "DKR" for x in got["audit"]) == n and GOOD.fullmatch("ua" * ((len(got["audit"]) - got["audit"].count("D")) // 2))
