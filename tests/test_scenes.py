"""Scenes against counts by hand, with one person who searched for everything."""

import pytest

from demandlens.plans import scenes

SEARCHES = [
    ("ann", "Aphex Twin windowlicker"), ("ann", "aphex twin XTAL"), ("ann", "windowlicker"), ("bob", "aphex, autechre"),
    ("cat", "muse hysteria"), ("dan", "muse"), ("dan", None), (None, "aphex"), ("eve", ""), ("eve", "Autechre!"),
]


def expected(rows, seeds, k):
    words = {}
    for person, text in rows:
        if person is not None:
            for word in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
                words.setdefault(person, set()).add(word)
    scene = {p for p, w in words.items() if w & set(seeds)}
    known = set().union(*words.values())
    out = {}
    for word in known:
        people = {p for p, w in words.items() if word in w}
        share = lambda n, total: (n + k) / (total + k * len(known))
        a, b = len(people & scene), len(people)
        out[word] = (a, b, pytest.approx(share(a, len(scene)) / share(b, len(words))))
    return out


@pytest.mark.parametrize("k", [0.5, 1.0, 20.0])
def test_lift_by_hand(spark, k):
    crawl = [("crawler", f"aphex word{n} muse") for n in range(400)]
    df = spark.createDataFrame(SEARCHES + crawl, "searcher_pseudonym string, query_text string").repartition(3)
    pairs = scenes.person_words(df)
    got = {r.word: (r.scene_people, r.people, r.lift) for r in scenes.scene_lift(pairs, ["APHEX", "xtal"], k).collect()}
    assert got == expected(SEARCHES + crawl, ["aphex", "xtal"], k)
    assert len(got) == 407


def test_recommendations_leave_seeds_and_rare_words_out(spark):
    df = spark.createDataFrame(SEARCHES * 2, "searcher_pseudonym string, query_text string")
    pairs = scenes.person_words(df)
    found = scenes.recommended(pairs, ["aphex"], size=2, least_people=1).collect()
    assert [(r.position, r.word, r.scene_people) for r in found] == [(1, "twin", 1), (2, "windowlicker", 1)]
    assert scenes.recommended(pairs, ["aphex"], least_people=2).collect() == []
    nobody = scenes.scene_lift(pairs, ["unknown"])
    assert {r.scene_people for r in nobody.collect()} == {0}
    assert scenes.scene_lift(pairs.where("false"), ["aphex"]).collect() == []
    for seeds, k in (([], 1.0), (["a"], 0.0)):
        with pytest.raises(ValueError):
            scenes.scene_lift(pairs, seeds, k)
