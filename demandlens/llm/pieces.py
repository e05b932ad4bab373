"""Pieces of a SentencePiece model and shared-prefix segmentation of words.

Words are sorted, so equal prefixes are neighbours: walking them in that order is a
depth-first walk of their trie. The forward state of every prefix on the current path
lies on a stack; the next word keeps the states of the prefix it shares with the word
before and adds the rest. Each trie node is computed once.

Two kinds of model:

* unigram — the state is the best score of the prefix and its last piece (Viterbi);
* byte-pair merges — the merged pieces of a prefix are those of a shorter prefix plus
  one last piece, and exactly one choice is stable: the pair at the seam must be what
  merging the two pieces' characters gives. The state is that last piece. Highest
  scores would choose other pieces than merging does, so the model's kind decides.

Characters without a piece become their UTF-8 byte pieces (or the unknown piece).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Words a task remembers with their pieces; about 120 bytes each, held twice at most.
REMEMBERED = 200_000
#: Seams of pieces and steps between states that a model remembers.
REMEMBERED_SEAMS = 300_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0

_RUNS = re.compile("▁+[^▁]*|[^▁]+")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """Pieces, scores and settings of a model file; small (one vocabulary)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = f.read()
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown, self.kind, self.prefix_space = 0, UNIGRAM, True
        for field, value in _fields(message):
            if field == 1:
                self._add(dict(_fields(value)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                settings = dict(_fields(value))
                self.prefix_space = bool(settings.get(3, 1))
                if settings.get(2) or settings.get(4, 1):
                    raise ValueError("only models without text normalisation are supported")
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("pieces that go on over a space are not supported")

    def _add(self, piece: dict) -> None:
        text, kind, i = piece[1].decode(), piece.get(3, NORMAL), len(self.pieces)
        self.pieces.append(text)
        self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
        if kind == USER_DEFINED:
            raise ValueError("user-defined symbols are not supported")
        if kind == NORMAL:
            self.ids[text] = i
        elif kind == BYTE:
            self.byte_ids[int(text[3:5], 16)] = i
        elif kind == UNKNOWN:
            self.unknown = i


class PieceModel(Pieces):
    """A model that segments words: how pieces are merged, and states by prefix."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0)
        #: The two pieces that a longer piece is merged from last, if merging makes it.
        self.halves: dict[str, tuple[str, str]] = {}
        lengths: dict[str, set[int]] = {}
        for x in self.ids:
            if len(x) == 1:
                continue
            parts = self.merge(x, stop=2)
            if self.kind == BPE and (len(parts) > 2 or len(self.merge(x)) > 1):
                continue
            self.halves[x] = tuple(parts)
            lengths.setdefault(x[-2:], set()).add(len(x))
        #: Lengths of the pieces that end in two given characters, longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self._seams: dict[str, dict[str, bool]] = {x: {} for x in self.halves}
        self._edges: tuple[dict, dict] = ({}, {})
        self._n_seams = self._n_steps = 0
        self._alphabet = set("".join(self.halves))
        self._states = self._automaton()

    def _automaton(self) -> dict[str, dict]:
        """States by their text: the longest start of a piece that ends a prefix.

        A state holds the pieces that end there, longest first, each with its length and
        known seams (key 0), its text (key 1), and the next states by character.
        """
        starts = {x[:i] for x in self.halves for i in range(1, len(x) + 1)} | {""}
        states = {}
        for text in starts:
            ends = [text[i:] for i in range(len(text) - 1) if text[i:] in self.halves]
            states[text] = {0: tuple((len(x), x, self._seams[x]) for x in ends), 1: text}
        return states

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown]

    def words(self, text: str) -> list[str]:
        """The text with marked spaces, cut before each run of them."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.prefix_space:
            text = " " + text
        if "  " in text:
            return _RUNS.findall(text.replace(" ", SPACE))
        cut = text.replace(" ", " ▁").split(" ")
        return cut if cut[0] else cut[1:]

    # -- byte-pair merges --

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Pieces by merging neighbours, highest score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts of a piece at one side as it grows, with the score that ends each."""
        chain = self._edges[side].get(piece)
        if chain is None:
            chain, part = [(piece, float("-inf"))], piece
            while len(part) > 1 and part in self.halves:
                score, part = self.scores[self.ids[part]], self.halves[part][side]
                chain.append((part, score))
            if piece in self.ids:
                self._edges[side][piece] = chain
        return chain

    def stable(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives just these two pieces.

        It does unless, while both grow, the parts at the seam are a piece themselves that
        is merged before the next merge on either side. Runs of spaces, whose scores
        are equal, are merged in full.
        """
        known = self._seams.get(right)
        found = known.get(left) if known is not None else None
        if found is None:
            if left[-1] == right[0] == SPACE:
                found = self.merge(left + right) == [left, right]
            else:
                found = not self._crossed(left, right)
            if known is not None:
                if self._n_seams >= REMEMBERED_SEAMS:
                    for seams in self._seams.values():
                        seams.clear()
                    self._n_seams = 0
                known[left] = found
                self._n_seams += 1
        return found

    def _crossed(self, left: str, right: str) -> bool:
        ids, scores, others = self.ids, self.scores, self._edge(right, 0)
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in others:
                found = ids.get(a + b)
                if found is not None and scores[found] > a_ends and scores[found] >= b_ends:
                    return True
        return False

    # -- forward states --

    def _paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], int]]:
        """Each word with the last piece of its every prefix, and how much it shares."""
        last, score, state, before = [""], [0.0], [self._states[""]], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            if self.kind == BPE:
                del state[shared + 1 :]
                self._merged(word, shared, last, state)
            else:
                del score[shared + 1 :]
                for i in range(shared + 1, len(word) + 1):
                    piece, value = self._best(word, i, last, score)
                    last.append(piece)
                    score.append(value)
            before = word
            yield word, last, shared

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], list[int]]]:
        """Each word with the last piece and the number of ids of its every prefix.

        The lists are the walk's own and change with the next word.
        """
        count, ids = [0], self.ids
        for word, last, shared in self._paths(words):
            del count[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                piece = last[i]
                count.append(count[i - len(piece)] + (1 if piece in ids else len(self.ids_of(piece))))
            yield word, last, count

    def _merged(self, word: str, shared: int, last: list[str], state: list[dict]) -> None:
        """Appends the last piece and the state of every longer prefix of the word."""
        now = state[shared]
        for i in range(shared, len(word)):
            chosen = word[i]
            now = now.get(chosen) or self._step(now, chosen)
            state.append(now)
            for size, piece, seams in now[0]:
                if size <= i:
                    left = last[i + 1 - size]
                    fits = seams.get(left)
                    if fits is None:
                        fits = self.stable(left, piece)
                    if not fits:
                        continue
                chosen = piece
                break
            last.append(chosen)

    def _step(self, state: dict, char: str) -> dict:
        """The state after one more character."""
        text = state[1] + char
        while text not in self._states:
            text = text[1:]
        if char in self._alphabet:
            if self._n_steps >= REMEMBERED_SEAMS:
                for x in self._states.values():
                    ends, own = x[0], x[1]
                    x.clear()
                    x[0], x[1] = ends, own
                self._n_steps = 0
            state[char] = self._states[text]
            self._n_steps += 1
        return self._states[text]

    def _best(self, word: str, i: int, last: list[str], score: list[float]) -> tuple[str, float]:
        piece, best = "", 0.0
        for size in (*self.lengths.get(word[max(0, i - 2) : i], ()), 1):
            found = self.ids.get(word[i - size : i]) if size <= i else None
            if found is None and size > 1:
                continue
            own = self.lowest - UNKNOWN_PENALTY if found is None else self.scores[found]
            if not piece or score[i - size] + own > best:
                piece, best = word[i - size : i], score[i - size] + own
        return piece, best

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its ids."""
        known = self.ids.get
        for word, last, _ in self._paths(words):
            out, i = [], len(word)
            while i:
                piece = last[i]
                found = known(piece)
                if found is None:
                    out += reversed(self.ids_of(piece))
                else:
                    out.append(found)
                i -= len(piece)
            out.reverse()
            yield word, out
