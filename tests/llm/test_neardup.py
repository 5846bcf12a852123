import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import neardup
from faultloom.llm.neardup import covering_keys, flag_array, flagged, least_agreements, parity_sketch, similar_groups, similar_pairs, similar_sets, term_hashes

SCHEMA = "id long, terms array<string>, h string, rep string, key string"


def brute(rows, t):
    rows = {r[0]: set(r[1]) for r in rows if r[0] is not None and r[1]}
    return {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if len(rows[a] & rows[b]) >= t * len(rows[a] | rows[b])}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return [(r.id_a, r.id_b) for r in similar_pairs(df, F.col("terms"), **kw).collect()]


def edited(rng, base, vocab, n):
    t = set(base)
    for _ in range(n):
        if rng.random() < 0.5 and len(t) > 1:
            t.discard(rng.choice(sorted(t)))
        else:
            t.add(rng.choice(vocab))
    return sorted(t)


@pytest.mark.parametrize("bucket", [1000, 8, 0])
def test_matches_brute_force(spark, bucket):
    """With overfull buckets, down to all of them, the refinement has to find every pair."""
    rng = random.Random(bucket)
    vocab = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        base = rng.sample(vocab, rng.choice([1, 2, 3, 5, 9, 14]))
        rows += [(3 * i + k, edited(rng, base, vocab, rng.randrange(4))) for k in range(3)]
    got = run(spark, rows, bucket=bucket)
    assert len(got) == len(set(got)) and set(got) == brute(rows, Fraction(7, 10))


def test_edges(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, []), (4, None), (None, ["a", "b"]), (5, ["a", "b"]), (5, ["a", "b"]), (6, [f"t{i}" for i in range(10)]), (7, [f"t{i}" for i in range(7)]), (8, [f"t{i}" for i in range(6)]), (9, [f"z{i}" for i in range(5000)]), (10, [f"z{i}" for i in range(4000)])]
    assert set(run(spark, rows)) == {(1, 2), (1, 5), (2, 5), (6, 7), (7, 8), (9, 10)}
    assert run(spark, []) == [] and run(spark, [(1, [])]) == []


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(i, ["hot", "copy"] if i % 3 == 0 else [f"u{i}", f"v{i}"]) for i in range(90)]
    assert len(run(spark, rows, bucket=4)) == 30 * 29 // 2


@pytest.mark.parametrize("parts, q", [(1, 1), (1, 2), (2, 2), (5, 2), (3, 4)])
def test_masks_cover_the_radius(parts, q):
    rng = np.random.default_rng(parts * q)
    for _ in range(200):
        r = int(rng.integers(0, parts * q))
        base = rng.integers(-(2**62), 2**62, size=30)
        drop = rng.choice(30, size=rng.integers(0, r + 1), replace=False)
        other = np.append(np.delete(base, drop), rng.integers(-(2**62), 2**62, size=r - len(drop)))
        h = np.append(base, other)
        row = np.repeat([0, 1], [len(base), len(other)])
        k, _ = covering_keys(h, row, 2, parts, q)
        assert (k[0] == k[1]).sum() >= least_agreements(np.array([r]), parts, q)[0] > 0


def test_masks_alone_find_pairs_within_their_radius(spark):
    """Sets of 60 terms of which some occur nowhere else: no refinement is needed."""
    rng = random.Random(3)
    rows, true = [], set()
    for i in range(0, 400, 2):
        base = [f"{i}-{k}" for k in range(55)]
        rows += [(i, base + [f"a{i}-{k}" for k in range(4)]), (i + 1, base[: 55 - i % 9] + [f"b{i}-{k}" for k in range(4)])]
        true.add((i, i + 1))
    df = spark.createDataFrame(rows, "rep long, t array<string>").select("rep", term_hashes(F.col("t")).alias("h"))
    got = {(r.a, r.b) for r in similar_sets(df, masks_only=True).collect()}
    assert got == true


def test_collisions_in_flag_arrays_lose_nothing(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    bases = [rng.sample(vocab, 20) for _ in range(15)]
    rows = [(i, edited(rng, rng.choice(bases), vocab, rng.randrange(5))) for i in range(90)]
    rows = [r for i, r in enumerate(rows) if set(r[1]) not in [set(x[1]) for x in rows[:i]]]
    df = spark.createDataFrame(rows, "rep long, t array<string>").select("rep", term_hashes(F.col("t")).alias("h"))
    got = {(r.a, r.b) for r in similar_sets(df, bucket=5, bits=64).collect()}
    assert got == brute(rows, Fraction(7, 10))


def test_flags(spark):
    x = [-(2**63), -1, 0, 1, 63, 64, 2**62]
    f = flag_array(spark.createDataFrame([(v,) for v in x], "x long"), 1 << 12)
    assert flagged(f, np.array(x)).all() and not flagged(f, np.array([2, 62, 65, 1000])).any()


def test_sizes_of_neighbouring_families_meet(spark):
    t = [f"t{i}" for i in range(400)]
    rows = [(1, t[:100]), (2, t[:128]), (3, t[:129]), (4, t[:140]), (5, t[:256]), (6, t[:257]), (7, t[:365])]
    assert set(run(spark, rows)) == brute(rows, Fraction(7, 10))


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(100):
        pool = rng.integers(-(2**62), 2**62, size=60)
        a, b = (pool[rng.random(60) < 0.5] for _ in range(2))
        if not len(a) or not len(b):
            continue
        s = parity_sketch(np.append(a, b), np.array([0, len(a)]))
        bits = sum(bin(int(x[0] ^ x[1]) & (2**64 - 1)).count("1") for x in s)
        assert bits <= len(set(a) ^ set(b))


def test_groups_agree_with_pairs(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(50)]
    bases = [rng.sample(vocab, 8) for _ in range(8)]
    rows = [(i, edited(rng, rng.choice(bases), vocab, rng.randrange(3))) for i in range(60)] + [(100, None), (101, [])]
    pairs = brute(rows, Fraction(7, 10))
    group = {i: i for i, t in rows if t}
    for _ in range(60):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = {r.id: (r.group_id, r.n_links) for r in similar_groups(df, F.col("terms")).collect()}
    assert got == {i: (g, sum(i in p for p in pairs)) for i, g in group.items()}


def prefix_rows(sets, levels=3):
    """What rows of prefixes carry, for sets of numbers in their order."""
    out = {k: [] for k in ("key", "rep", "n", "s1", "s2", "place", "open")}
    off, rest = [0], []
    for rep, t in sets:
        t = np.array(sorted(t))
        s1, s2 = parity_sketch(neardup.mix(t), np.array([0]))
        _, longest = neardup.prefix_lengths(np.array([len(t)]), Fraction(7, 10))
        for i in range(int(longest[0])):
            for k, v in (("key", t[i]), ("rep", rep), ("n", len(t)), ("s1", s1[0]), ("s2", s2[0]), ("place", i), ("open", True)):
                out[k].append(v)
            rest += t[i + 1 : longest[0] + neardup.DEPTH - 1].tolist()
            off.append(len(rest))
    return [np.array(v) for v in out.values()] + [np.array(off), np.array(rest).astype(np.uint16)]


@pytest.mark.parametrize("entries", [1 << 21, 50])
def test_frequent_prefix_terms_are_divided_by_further_terms(monkeypatch, entries):
    """Pairs come out whole, and terms in most sets do not have all their rows compared."""
    monkeypatch.setattr(neardup, "ENTRIES", entries)
    rng = random.Random(21)
    sets = []
    for i in range(150):
        base = rng.sample(range(200), rng.choice([1, 2, 3, 4, 6, 12, 20]))
        base += [x + 65536 for x in base[:2]]  # of one short hash
        sets += [set(base), set(base) ^ set(rng.sample(range(200), 2)), {0, *base}]
    sets = [(i, t) for i, t in enumerate({frozenset(t): 0 for t in sets}) if t]
    f, likeness = Fraction(3, 17), Fraction(7, 10)
    want = brute(sets, likeness)
    for few in (0, 3, 10**6):
        a, b = neardup.pairs_of_prefixes(*prefix_rows(sets), f, likeness, few)
        assert want <= set(zip(a.tolist(), b.tolist())) and (a < b).all()
    hot = [(i, {0, *rng.sample(range(1, 2000), 40)}) for i in range(1500)]
    compared = {}
    pairs = neardup._pairs
    for few in (neardup.FEW, 10**6):
        compared[few] = []
        monkeypatch.setattr(neardup, "_pairs", lambda *x: (compared[few].append(len(p[0])) or p for p in pairs(*x)))
        neardup.pairs_of_prefixes(*prefix_rows(hot), f, likeness, few)
    assert sum(compared[10**6]) > 3 * sum(compared[neardup.FEW])
