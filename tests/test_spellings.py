"""Spellings of one artist in one entry."""

from datetime import datetime

from demandlens import schemas as S
from demandlens.operators import hourly as H
from demandlens.plans import spellings
from demandlens.plans.periods import resolve_period

WINDOW = resolve_period("week", datetime(2026, 8, 12))


def test_spellings_count_together(spark):
    at, old = datetime(2026, 8, 11, 9), datetime(2026, 8, 3)
    names = [("The Beatles", 1), ("beatles", 2), ("beatles", 1), ("BEATLES", 3), ("Sigur Rós", 1), ("sigur ros", 2),
             ("simon & garfunkel", 4), ("Simon and Garfunkel", 4), ("!!!", 5), ("???", 5)]
    rows = [(at, at.date(), f"{p:016d}", n, "q", name, "", "", 0.9, 2, 2) for n, (name, p) in enumerate(names)]
    rows += [(at, at.date(), f"{9:016d}", 90, "q", "sigur ros", "", "", 0.9, 2, 1),
             (old, old.date(), f"{8:016d}", 91, "q", "beatles", "", "", 0.9, 2, 2)]
    states = H.hourly_states(spark.createDataFrame(rows, S.PARSED_SCHEMA))
    got = [tuple(r) for r in spellings.merged_chart(states, WINDOW).collect()]
    assert got == [
        (1, "beatles", 4, 3, 3), (2, "sigur ros", 3, None, 2), (3, "Simon and Garfunkel", 2, 1, 2),
        (4, "!!!", 1, 1, 1), (5, "???", 1, 1, 1),
    ]
    assert [r.artist_name for r in spellings.merged_chart(states, WINDOW, 1).collect()] == ["beatles"]
    assert spellings.merged_chart(states.where("false"), WINDOW).count() == 0
