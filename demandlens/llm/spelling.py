"""Spelling variants: the vocabulary composed with one edit and with itself (operator 11).

The vocabulary is an acceptor V; a transducer E allows one inserted, deleted or replaced
code point. The pairs that V, E and V accept together are the near words. A composed state
is (state of the first word, edited or not, state of the second); as long as nothing is
edited both words stand at one state, so composition branches only where the edit is made,
at the end of the pair's longest common prefix, and goes on where both states read the same.

Partitions are those of the composed machine's first states. A prefix that more than
`group_words` words share is open: its words part by their next code point, and pairs whose
edit stands right there meet in a join on what is left of the word without that code point
(one row per word and open prefix; at most one partner per code point of the alphabet).
Words below a prefix that is not open make one group: a task builds their minimised
acceptor and composes it. Each pair is found once, at its longest common prefix, and
is added to both words' counts at once; pairs are never listed.

A word's form is its near word of largest n (ties: the smallest), if that n is at least
`ratio` times its own; forms lead on to a root. n grows with every step, so forms have no
cycles, and doubling the steps reaches all roots in a few rounds.

Words need not be letters; comparison is by code points. Words are distinct: equal rows are
added up. Null words are left out. An empty table gives no rows, a word without near
words counts 0 and is its own root. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import bound_batches, stored

#: Words in a group that one task composes.
GROUP_WORDS = 1 << 15
#: Most open prefixes of one length that are broadcast; beyond it they are joined by shuffle.
BROADCAST_PREFIXES = 1 << 20
RATIO = 10
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: One word in so many loses a code point in its document, by the checksum of both.
DROP_ONE_IN = 31

_PART = "word string, n_near long, minus_n long, near string"


def letter_words(text: Column) -> Column:
    """Runs of letters, A to Z in lower case, as an array; null texts have none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(f"({LETTERS})"), 1)


def counted_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, misspell: bool = False,
) -> DataFrame:
    """word, n over all texts. `misspell` deletes a code point of one in 31 pairs of key and word.

    With a null key, words stay as they are.
    """
    # Plain explode would cut the texts once more to leave out those without words.
    rows = docs.select(
        F.col(key).cast("string").alias("key"), F.explode_outer(letter_words(F.col(text))).alias("word")
    )
    rows = rows.where(F.length("word") >= least_letters)
    if misspell:
        h = F.crc32(F.concat("key", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(h % DROP_ONE_IN == 0, short).otherwise(F.col("word")).alias("word"))
        rows = rows.where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def variants(words: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for rows of word and n."""
    bound_batches(words.sparkSession)
    known = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = stored(known, "spelling-words")
    groups, met = _partitions(known, group_words)
    parts = [groups.groupBy("prefix").applyInPandas(_compose_group, _PART), *([] if met is None else [met])]
    parts = [p.select("word", "n_near", F.struct("minus_n", F.col("near").alias("word")).alias("best")) for p in parts]
    near = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.minus_n")
    is_form = F.coalesce(best_n >= ratio * F.col("n"), F.lit(False))
    formed = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, best_n).alias("form_n"),
    )
    formed = stored(formed, "spelling-forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _partitions(known: DataFrame, group_words: int) -> tuple[DataFrame, DataFrame | None]:
    """Words with the prefix of their group; counts and best words from edits at open prefixes."""
    rest, length, groups, met = known, 0, None, None
    while True:
        prefix = F.substring("word", 1, length)
        rest = rest.select("word", "n", prefix.alias("prefix"))
        opened = rest.groupBy("prefix").count().where(F.col("count") > group_words).select("prefix")
        opened = stored(opened, "spelling-open")
        n_open = opened.count()
        if not n_open:
            return (rest if groups is None else groups.unionByName(rest)), met
        side = F.broadcast(opened) if n_open <= BROADCAST_PREFIXES else opened
        closed = rest.join(side, "prefix", "left_anti")
        groups = closed if groups is None else groups.unionByName(closed)
        rest = stored(rest.join(side, "prefix", "left_semi").select("word", "n"), "spelling-rest")
        found = _edits_at(rest, length)
        met = found if met is None else met.unionByName(found)
        length += 1


def _edits_at(words: DataFrame, place: int) -> DataFrame:
    """Near words that part at one place, which is the end of their common prefix.

    Those that lose their code point there, and those that need not, meet on what is left.
    """
    before = F.substring("word", 1, place)
    lost = words.where(F.length("word") > place).select(
        F.concat(before, F.substring("word", F.lit(place + 2), F.length("word"))).alias("left"),
        F.struct("word", "n", F.substring("word", place + 1, 1).alias("at")).alias("member"),
    )
    whole = words.select(
        F.col("word").alias("left"), F.struct("word", "n", F.lit("").alias("at")).alias("member")
    )
    met = lost.unionByName(whole).groupBy("left").agg(F.collect_list("member").alias("members"))
    met = met.where(F.size("members") > 1).withColumn("next", F.substring("left", place + 1, 1))

    def others(member: Column) -> Column:
        # A code point inserted before an equal one parts the words later, and is found there.
        apart = lambda a, b: (a["at"] != "") | (b["at"] != F.col("next")) | (b["at"] == "")
        return F.filter(
            "members",
            lambda y: (y["at"] != member["at"]) & apart(member, y) & apart(y, member),
        )

    near = met.select(
        F.explode(F.transform("members", lambda x: F.struct(x["word"].alias("word"), others(x).alias("near"))))
        .alias("e")
    ).where(F.size("e.near") > 0)
    best = F.array_min(F.transform("e.near", lambda y: F.struct((-y["n"]).alias("minus_n"), y["word"].alias("word"))))
    return near.select(
        F.col("e.word").alias("word"), F.size("e.near").cast("long").alias("n_near"), best.alias("best")
    ).select("word", "n_near", F.col("best.minus_n").alias("minus_n"), F.col("best.word").alias("near"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to, by doubling the steps."""
    while True:
        links = stored(links, "spelling-roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = links.join(on, "root", "left")
        if longer.where("beyond IS NOT NULL").isEmpty():
            return links
        links = longer.select("word", F.coalesce("beyond", "root").alias("root"))


# -- in one group: the minimised acceptor and its composition ----------------------


class Acceptor:
    """The least automaton that accepts some words, built from the sorted words.

    State 0 is the only one without arcs; `arcs[s]` maps code points to states, `final[s]`
    says whether a word may end in s, `lengths[s]` has a bit for each length left.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            same = _common(last, word)
            self._close(path, last, same)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        """States behind `depth` change no more: each becomes the one with equal right side."""
        while len(path) > depth + 1:
            arcs, final = path.pop()
            path[-1][0][word[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        shape = (final, *arcs.items())
        if shape not in self._known:
            self._known[shape] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            lengths = 1 if final else 0
            for to in arcs.values():
                lengths |= self.lengths[to] << 1
            self.lengths.append(lengths)
        return self._known[shape]

    def endings(self, a: int, b: int, apart: str | None = None) -> Iterator[str]:
        """Words that both states accept, without those that begin with `apart`."""
        arcs, final, lengths = self.arcs, self.final, self.lengths
        waiting = [(a, b, "", apart)]
        while waiting:
            a, b, read, apart = waiting.pop()
            if not lengths[a] & lengths[b]:
                continue
            if final[a] and final[b]:
                yield read
            right = arcs[b]
            for letter, to in arcs[a].items():
                if letter != apart and letter in right:
                    waiting.append((to, right[letter], read + letter, None))

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of endings from one state whose first code points differ, one edit apart."""
        arcs = self.arcs[state]
        ways = list(arcs.items())
        pairs = []
        for i, (letter, to) in enumerate(ways):
            for other, there in ways[:i]:
                if self.lengths[to] & self.lengths[there]:
                    pairs += [(letter + x, other + x) for x in self.endings(to, there)]
            pairs += [(letter + x, x) for x in self.endings(to, state, apart=letter)]
        return pairs

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs one edit apart; what a state adds is worked out once."""
        known: dict[int, list[tuple[str, str]]] = {}
        waiting = [(self.start, "")]
        while waiting:
            state, read = waiting.pop()
            if state not in known:
                known[state] = self.edits(state)
            for x, y in known[state]:
                yield read + x, read + y
            waiting += [(to, read + letter) for letter, to in self.arcs[state].items()]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _compose_group(group: pd.DataFrame) -> pd.DataFrame:
    """word, number of near words and the best of them, for words of one group that have any."""
    n_of = dict(zip(group["word"].tolist(), group["n"].tolist()))
    shared = len(group["prefix"].iloc[0])
    head = group["prefix"].iloc[0]
    count: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}

    def meet(word: str, near: str) -> None:
        count[word] = count.get(word, 0) + 1
        rank = (-n_of[near], near)
        if word not in best or rank < best[word]:
            best[word] = rank

    acceptor = Acceptor(sorted(w[shared:] for w in n_of))
    for x, y in acceptor.near_pairs():
        meet(head + x, head + y)
        meet(head + y, head + x)
    return pd.DataFrame(
        [(w, c, *best[w]) for w, c in count.items()], columns=["word", "n_near", "minus_n", "near"]
    )
