"""Cheapest repairs against all sequences of edits, and against DuckDB."""

import hashlib
import random
import re

import duckdb
import pytest

from channelweave.llm import repair

ROLES = ["system", "user", "assistant", "tool", ""]
TEXTS = ["Fine.", "Cut off", " \n", "", "Well? "]
SCHEMA = "conv_id long, turn long, role string, text string"


def fault(turns, n):
    role, text = turns[n]
    kept = text.strip(" \t\n\v\f\r")
    return "b" if not kept else "d" if turns[n] in turns[:n] else "t" if kept[-1] not in ".!?" else ""


def brute(turns):
    """(cost, audit, repaired) over all edits with at most two inserts at a place."""
    best = None

    def go(n, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for k in range(3):
            for made in [[]] if not k else [[a] for a in ("user", "assistant")] if k == 1 else [["user", "assistant"], ["assistant", "user"]]:
                so, a, c = out + [(r, "") for r in made], audit + "I" * k, cost + 3 * k
                if n == len(turns):
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in so)) and (best is None or (c, a) < best[:2]):
                        best = (c, a, so)
                    continue
                go(n + 1, c + 4, a + "D", so)
                f, (role, text) = fault(turns, n), turns[n]
                if f in ("", "t"):
                    c += 3 * (f == "t")
                    go(n + 1, c, a + "K", [*so, (role, text)])
                    for r in ("user", "assistant"):
                        go(n + 1, c + 3, a + "R", [*so, (r, text)])

    go(0, 0, "", [])
    return best


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def solved(spark, turns, length=repair.SEGMENT):
    rows = repair.write_table(repair.faults(spark.createDataFrame(turns, SCHEMA)), "turns")
    edits = repair.cheapest_edits(rows, length)
    out = repair.carry_out(rows, edits, repair.write_digests, "repaired_sha256 string")
    return {r["conv_id"]: (r["cost"], r["audit"]) for r in edits.collect()}, {r["conv_id"]: r["repaired_sha256"] for r in out.collect()}


@pytest.mark.parametrize("length", [2, repair.SEGMENT])
def test_brute_force(spark, length):
    r = random.Random(7)
    convs = {c: [(r.choice(ROLES), r.choice(TEXTS)) for _ in range(r.randint(1, 4))] for c in range(120)}
    edits, digests = solved(spark, [(c, n, *t) for c, ts in convs.items() for n, t in enumerate(ts)], length)
    for c, turns in convs.items():
        cost, audit, out = brute(turns)
        assert edits[c] == (cost, audit), turns
        assert digests[c] == digest(out)


def test_segments_join(spark):
    """A conversation over three levels of segments costs what it costs whole."""
    r = random.Random(3)
    turns = [(1, n, r.choice(ROLES), f"{n} {r.choice(TEXTS)}") for n in range(90)]
    assert solved(spark, turns, 4) == solved(spark, turns)


def test_edge_cases(spark):
    """Null ids, turns, roles and texts; ties; repeated rows; long texts; extra columns."""
    rows = [
        (None, None, "user", "Null id."), (None, 1, None, None), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, None, "system", "First."),
        (2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "é中\U0001f600."), (3, 0, "tool", ""), (4, 2, "user", "B."), (4, 2, "assistant", "C."),
    ]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], f"{SCHEMA}, kind string, pos int")
    found, turns = repair.repair_conversations(df)
    got = {r["conv_id"]: r for r in found.collect()}
    assert {c: (r["cost"], r["audit"]) for c, r in got.items()} == {None: (7, "KDI"), 1: (7, "KKDI"), 2: (0, "KK"), 3: (4, "D"), 4: (6, "IKKI")}
    assert (got[1]["duplicate"], got[1]["gaps"], got[1]["illegal"], got[None]["blank"]) == (1, 0, 1, 1)
    written = sorted((r["conv_id"], r["n"], r["edit"], r["role"], len(r["text"])) for r in turns.collect() if r["conv_id"] in (1, 2))
    assert written == [(1, 0, "K", "system", 6), (1, 1, "K", "user", 2), (1, 2, "I", "assistant", 0), (2, 0, "K", "user", 300_001), (2, 1, "K", "assistant", 4)]
    none, nothing = repair.repair_conversations(df.where("false"))
    assert none.count() == nothing.count() == 0


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(repair.OP13_SQL)
    names = [c[0] for c in want.description]
    got = repair.op13_repair_conversations(spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
