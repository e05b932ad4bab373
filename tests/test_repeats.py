"""Steady repeats and bursts, against plain loops and at their edges."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from demandlens.plans import repeats

SCHEMA = "searcher_pseudonym string, query_text string, received_at timestamp_ntz, query_no int"
START = datetime(2024, 1, 5)


def rows_of(spark, seconds):
    rows = [(p, q, START + timedelta(seconds=s) if s is not None else None, 0) for p, q, s in seconds]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def asked():
    """One pair holds a third of all rows; some rows have no person, words or time."""
    rnd = random.Random(3)
    out = [("hot", "a", 300 * i + rnd.randint(-9, 9)) for i in range(300)]
    out += [(f"p{rnd.randint(0, 9)}", rnd.choice("abc"), rnd.randint(0, 20_000)) for _ in range(560)]
    return out + [(None, "a", 5), ("p1", None, 5), ("p1", "a", None)] * 2 + out[:40]


def moments(asked):
    found = defaultdict(set)
    for p, q, s in asked:
        if None not in (p, q, s):
            found[p, q].add(s)
    return {k: sorted(v) for k, v in found.items()}


def test_repeats_as_loops_find_them(spark, asked):
    expected = set()
    for (p, q), at in moments(asked).items():
        gaps = Counter(int((b - a + 30) // 60 * 60) for a, b in zip(at, at[1:]))
        if sum(gaps.values()) >= 3:
            interval, n = min(gaps.items(), key=lambda x: (-x[1], x[0]))
            expected.add((p, q, len(at), interval, n, n / (len(at) - 1)))
    got = repeats.periodic_repeats(rows_of(spark, asked)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert next(r for r in got if r.searcher_pseudonym == "hot").interval_seconds == 300


def test_bursts_as_loops_find_them(spark, asked):
    expected = []
    for (p, q), at in moments(asked).items():
        groups = [[at[0]]]
        for a, b in zip(at, at[1:]):
            groups[-1].append(b) if b - a <= 200 else groups.append([b])
        expected += [(p, q, g[0], g[-1], len(g)) for g in groups if len(g) >= 2]
    got = repeats.bursts(rows_of(spark, asked), within=200, least=2).collect()
    in_seconds = [
        (p, q, (a - START).total_seconds(), (b - START).total_seconds(), n) for p, q, a, b, n in map(tuple, got)
    ]
    assert sorted(in_seconds) == sorted(expected)


def test_edges(spark):
    none = rows_of(spark, [])
    assert repeats.periodic_repeats(none).count() == repeats.bursts(none).count() == 0
    same = rows_of(spark, [("p", "a", 7)] * 9)
    assert repeats.periodic_repeats(same, least=1).count() == 0
    assert [r.searches for r in repeats.bursts(same, least=1).collect()] == [1]
    tie = rows_of(spark, [("p", "a", s) for s in (0, 60, 180, 240, 360)])
    assert repeats.periodic_repeats(tie).first().interval_seconds == 60
    edge = rows_of(spark, [("p", "a", s) for s in (0, 600, 1200, 1801)])
    assert [r.searches for r in repeats.bursts(edge).collect()] == [3]
    with pytest.raises(ValueError):
        repeats.periodic_repeats(none, tolerance=0)
    with pytest.raises(ValueError):
        repeats.bursts(none, least=0)
