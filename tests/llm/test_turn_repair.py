"""Conversation repair against a plain dynamic program over whole audit strings."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import turn_repair as T

BLANKS = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        by = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if by == 1:
            text = ""
        if by == 2:
            text = "".join(c for c in text if c not in ".!?")
        if by == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    return out


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
        seen.add((role, text))
        faults.append(fault)
    best = {"": (0, "", [])}  # by the last role's initial

    def grown(best):  # inserts
        best = dict(best)
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                new = "a" if q == "u" else "u"
                way = (c + 5, a + "I", [*out, ({"u": "user", "a": "assistant"}[new], "")])
                if new not in best or way[:2] < best[new][:2]:
                    best[new] = way
        return best
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (c, a, out) in grown(best).items():
            ways = [(q, c + 2, a + "D", out)]
            if fault in ("none", "truncated"):
                c += 5 * (fault == "truncated")
                if role[:1] == "s" and q == "" or role[:1] == "u" and q != "u" or role[:1] == "a" and q == "u":
                    ways.append((role[:1], c, a + "K", [*out, (role, text)]))
                ways.append(("a", c + 1, a + "R", [*out, ("assistant", text)]) if q == "u" else ("u", c + 1, a + "R", [*out, ("user", text)]))
            for then, *way in ways:
                if then not in new or way[:2] < list(new[then][:2]):
                    new[then] = tuple(way)
        best = new
    cost, audit, out = min((v for q, v in grown(best).items() if q in ("", "a")), key=lambda v: v[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    roles = [r[:1] for _, _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
NAMES = ("gaps", *T.SUMMARY, "cost", "audit", "repaired_sha256")


def order(row):
    return (row[1] is not None, row[1] or 0)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["", " \n", "Yes.", "No!  ", "and then", "é?", None, "x" * 9]
    out = []
    for conv in range(150):
        n, turn = int(rng.integers(1, 9)), 0
        for t in range(n):
            turn += int(rng.integers(1, 3))
            usual = rng.random() < 0.6
            out.append((conv, turn, ["user", "assistant"][t % 2] if usual else str(rng.choice(roles[:7])), f"Row {t}." if usual else texts[rng.integers(0, 8)]))
    for t in range(900):  # a conversation of a third of all rows
        out.append((7000, t, ["user", "assistant"][t % 2], f"Long {t % 500}" + "." * (t % 7 > 0)))
    return out + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (8000, None, None, None), (8001, 2, "sys", "Be kind."), (8001, 3, "user", "Hm?"),
                  (8002, 5, "user", "long " * 30000), (8002, 6, "assistant", "long. " * 30000)]


def test_repair_against_brute_force(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, conv int, sig string")
    before = T.repair
    for word_rows in (3, 1024):
        try:
            T.repair = lambda r, n=word_rows: before(r, n)
            got = {r.conv_id: tuple(r[c] for c in NAMES) for r in T.repair_digest(table.repartition(5)).collect()}
        finally:
            T.repair = before
        assert set(got) == {r[0] for r in rows}
        for conv in got:
            own = sorted(brute_damage([r for r in rows if r[0] == conv]), key=order)
            assert got[conv] == (brute_repair(own) if own else NOTHING), (conv, own[:9])


def test_repeated_rows_and_equal_turns(spark):
    """Copies of a row are duplicates, in whatever range they lie; rows of equal turns all count."""
    table = spark.createDataFrame([(1, 1, "user", "Same.")] * 400 + [(1, 1, "assistant", "Other.")] * 2 + [(2, t, "user", "x.") for t in range(50)],
                                  "conv_id long, turn long, role string, text string").repartition(4)
    done = T.repair(table, 8)
    one, two = done.summary.orderBy("conv").collect()
    assert (one.duplicate, one.gaps, one.audit.count("D"), len(one.audit)) == (400, 0, 400 + one.audit.count("I") * 0, 402 + one.audit.count("I"))
    assert (two.duplicate, two.cost, two.audit) == (49, 100, "D" * 50)
    assert sorted((r.role, r.text) for r in done.rows.collect())[-1][0] == "user"


def test_empty_table_and_roles(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.repair_digest(empty).count() == 0
    same = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "tool", "c.")], empty.schema)
    got = T.repair(same).summary.first()
    assert (got.cost, got.illegal) == (3, 2) and got.audit == "DKR"


def test_nodes_are_shared():
    made = []
    before = T.before
    try:
        T.before = lambda *a: made.append(a) or before(*a)
        words = sorted({"EI" * k + "EI" for k in range(40)} | {"A" + "EI" * 20, "M" + "EI" * 20}, key=lambda w: w[::-1])
        found = {w: (node.cost[0], audits[0]) for w, _, node, audits in T.walked([(w, True) for w in words])}
    finally:
        T.before = before
    assert len(made) == 80 + 2  # one node a suffix
    assert found["A" + "EI" * 20] == (0, "K" * 41) and found["M" + "EI" * 20] == (2, "D" + "K" * 40)


def test_damage(spark, rows):
    got = T.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_damage(rows)))
    assert got.where(F.col("text").isNull()).count() == 0
