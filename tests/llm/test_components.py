import random

import pytest

from faultloom.llm.components import connected_groups, match_groups, peel_giant
from faultloom.session import Scratch

ROWS = "id long, fingerprint string, verdict string, component long, vertex long"
PAIRS = "left_ref string, right_ref string, verdict string, id long"


def brute(rows, pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    refs = set()
    for l, r, v, _ in pairs:
        if v and v.strip().lower() == "match" and l and r and l.strip() and r.strip():
            l, r = l.strip(), r.strip()
            refs |= {l, r}
            p[find(l)] = find(r)
    ids = {r[0]: r[1] for r in rows if r[0] is not None}
    for i, f in ids.items():
        if f in refs and str(i) in refs:
            p[find(str(i))] = find(f)
    groups = {}
    for i, f in ids.items():
        k = f if f in refs else str(i) if str(i) in refs else None
        if k:
            groups.setdefault(find(k), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def run(spark, rows, pairs):
    got = match_groups(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS), spark.createDataFrame(pairs, PAIRS)).collect()
    assert len({r.id for r in got}) == len(got)
    return {r.id: r.group_id for r in got}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"f:{rng.randrange(25)}" if rng.random() < 0.6 else f"g:{i}") for i in range(1, 300)]
    refs = [str(rng.randrange(1, 320)) for _ in range(150)] + [f"f:{i}" for i in range(0, 30, 3)]
    pairs = [(rng.choice(refs), rng.choice(refs), rng.choice(["match", "MATCH", "no match", None]), 1) for _ in range(120)]
    assert run(spark, rows, pairs) == brute(rows, pairs)


def test_hub_and_long_chain(spark):
    rows = [(i, f"x:{i}") for i in range(1, 260)]
    pairs = [("1", str(i), "match", 0) for i in range(2, 100)] + [(str(i), str(i + 1), "match", 0) for i in range(99, 180)] + [(str(i + 1), str(i), "Match", 0) for i in range(200, 258)]
    got = run(spark, rows, pairs)
    assert got == brute(rows, pairs) and set(got.values()) == {1, 200}


def test_edges(spark):
    rows = [(1, "a:1"), (2, "a:1"), (2, "a:1"), (3, None), (4, "b:1"), (5, "c:1"), (None, "a:1"), (6, "d:1"), (7, "d:1")]
    pairs = [("a:1", "a:1", "match", 0), (" 3 ", "\t99", "MATCH", 0), ("99", "4", "match", 0), ("5", None, "match", 0), ("5", " ", "match", 0), ("6", "7", "no match", 0), ("zz:9", "5", "match", 0), ("5", "5", "match", 0)]
    assert run(spark, rows, pairs) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert run(spark, rows, []) == {} and run(spark, [], pairs) == {}


def test_unknown_key_and_odd_references_link(spark):
    rows = [(1, "p:1"), (2, "q:1"), (3, "r:1")]
    pairs = [("1", "gone:1", "match", 0), ("gone:1", "not a number", "match", 0), ("not a number", "2", "match", 0), ("3", "99999999999999999999", "match", 0)]
    assert run(spark, rows, pairs) == {1: 1, 2: 1}


@pytest.mark.parametrize("tail", [0.0, 0.5])
def test_peel(spark, tail):
    e = [(0, i) for i in range(1, 30)] + [(29, 30), (30, 31), (100, 101)]
    both = spark.createDataFrame(e + [(b, a) for a, b in e], "u long, v long")
    start, visited, rest = peel_giant(both, Scratch(spark), tail=tail)
    assert start == 0 and visited.count() == (32 if tail == 0 else 31)
    comp = {r.vertex: r.component for r in connected_groups(both.union(spark.createDataFrame([(7, None), (200, 200)], "u long, v long"))).collect()}
    assert len({comp[i] for i in range(32)}) == 1 and comp[100] == comp[101] != comp[0] and comp[200] not in (comp[0], comp[100])


def test_ids_of_19_digits(spark):
    big, most = 10**18 + 7, 2**63 - 1
    rows = [(big, "f:1", "", 0, 0), (most, "f:2", "", 0, 0), (3, "f:3", "", 0, 0)]
    pairs = [(str(big), "3", "match", 1), (str(most), str(most + 1), "match", 2), (str(most + 1), "3", "match", 3)]
    got = match_groups(spark.createDataFrame(rows, ROWS), spark.createDataFrame(pairs, PAIRS)).collect()
    assert {r.id: r.group_id for r in got} == {big: 3, most: 3, 3: 3}


def test_ids_of_any_size_and_spelling(spark):
    big = 10**18
    rows = [(i, f"k:{i}") for i in (7, 9, -5, big + 5, big + 6, 2**63 - 1, -(2**63), 0)]
    pairs = [(str(big + 5), str(big + 6), "match", 0), ("-5", " 9 ", "match", 0), ("007", "7", "match", 0), (str(2**63 - 1), str(-(2**63)), "match", 0), ("99999999999999999999", "0", "match", 0), ("+9", "7", "match", 0)]
    assert run(spark, rows, pairs) == brute(rows, pairs) == {big + 5: big + 5, big + 6: big + 5, -5: -5, 9: -5, 2**63 - 1: -(2**63), -(2**63): -(2**63)}


def test_unknown_references_link_but_do_not_come_out(spark):
    rows = [(1, "a:1"), (2, "a:2"), (3, "a:3")]
    pairs = [("1", "404", "match", 0), ("404", "none:here", "match", 0), ("none:here", "a:2", "match", 0)]
    assert run(spark, rows, pairs) == {1: 1, 2: 1}


def test_a_third_of_the_rows_carry_one_key(spark):
    rows = [(i, "hot:1" if i % 3 == 0 else f"c:{i}") for i in range(1, 3000)]
    pairs = [("hot:1", "1", "match", 0), ("c:2", "hot:1", "match", 0), ("4", "5", "match", 0)]
    assert run(spark, rows, pairs) == brute(rows, pairs)
