"""Frequent k-mers, hints, periods and cuts of many texts at once, as arrays of numbers inside a worker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions import sequence as S

BASE_ORDER = "ACGT"
#: Characters of the texts that go through together; one longer text goes alone.
TOGETHER = 1 << 18
#: Cuts of a text that overlap are followed this many steps for all texts at once, and then by the text's own split.
STEPS = 64


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(sizes: list[int]) -> Iterator[slice]:
    """Runs of texts of ``TOGETHER`` characters or one text."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > TOGETHER:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


@dataclass
class Level:
    """Frequent k-mers of one length, by text, then place of their prefix, then base added."""

    length: int
    owner: np.ndarray
    n: np.ndarray
    first: np.ndarray
    key: np.ndarray
    #: Places of all occurrences in ascending order, and the key of each.
    places: np.ndarray
    keys: np.ndarray


@dataclass
class Periods:
    """Of hints: the text, the length, the first place among all texts, and what cuts by it give."""

    owner: np.ndarray
    length: np.ndarray
    first: np.ndarray
    period: np.ndarray
    score: np.ndarray


def _leaders(owner: np.ndarray) -> np.ndarray:
    """Index of the first row of every owner, of rows by owner."""
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)


def _greatest(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Index of the first row with the greatest value of every owner, of rows by owner."""
    at = _leaders(owner)
    top = np.repeat(np.maximum.reduceat(value, at), np.diff(np.append(at, len(owner)))) if len(at) else value
    rows = np.flatnonzero(value == top)
    return rows[_leaders(owner[rows])]


class Texts:
    """Texts side by side, a character that is no base after each."""

    def __init__(self, seqs: list[str], cutoffs: list[int]):
        self.seqs = seqs
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.text = "\0".join([*seqs, ""])
        raw = codes(self.text)
        self.base = np.full(len(raw), 4, np.int8)
        for k, b in enumerate(BASE_ORDER):
            self.base[raw == ord(b)] = k
        self.cutoff = np.array(cutoffs, np.int64)

    def levels(self, depth: int) -> Iterator[Level]:
        """Every length from 2 on that has frequent k-mers beginning with the top base of their text."""
        kind = np.int32 if len(self.base) < 1 << 28 else np.int64
        of = np.repeat(np.arange(len(self.seqs), dtype=kind), self.size + 1)
        counts = np.bincount(of * 5 + self.base, minlength=5 * len(self.seqs)).reshape(-1, 5)
        tie = np.array([BASE_ORDER.index(b) for b in S.TIE_ORDER])
        top = tie[counts[:, tie].argmax(1)].astype(np.int8)
        places = np.flatnonzero(self.base == top[of]).astype(kind)
        group, owner = of[places], np.arange(len(self.seqs), dtype=kind)
        for length in range(2, depth + 1):
            base = self.base[places + (length - 1)]
            whole = base < 4
            if not whole.all():
                places, group, base = places[whole], group[whole], base[whole]
            key = group * 4 + base
            n = np.bincount(key, minlength=4 * len(owner))
            frequent = n > np.repeat(self.cutoff[owner], 4)
            stay = frequent[key]
            if not stay.all():
                places, key = places[stay], key[stay]
            if not len(places):
                return
            first = np.empty(len(n), kind)
            first[key[::-1]] = places[::-1]
            kept = np.flatnonzero(frequent)
            level = Level(length, owner[kept >> 2], n[kept], first[kept], kept, places, key)
            yield level
            # Groups are numbered by their first place, so that ties go to the earlier prefix.
            order = np.argsort(level.first, kind="stable")
            number = np.empty(len(n), kind)
            number[kept[order]] = np.arange(len(kept), dtype=kind)
            group, owner = number[key], level.owner[order]

    def hints(self, level: Level) -> np.ndarray:
        """Rows of the level: the most frequent k-mer of each text."""
        return _greatest(level.owner, level.n)

    def periods(self, level: Level, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Commonest distance between cuts by the k-mers in these rows, one of a text, and its share of the pieces."""
        length, owner = level.length, level.owner[rows]
        local = np.full(int(level.keys.max()) + 1 if len(level.keys) else 0, -1, np.int64)
        local[level.key[rows]] = np.arange(len(rows))
        who = local[level.keys]
        mine = who >= 0
        places, who = level.places[mine].astype(np.int64), who[mine]
        close = np.flatnonzero((who[1:] == who[:-1]) & (places[1:] - places[:-1] < length))
        texts: dict[int, np.ndarray] = {}
        if len(close):
            places, who = self._apart(places, who, length, np.unique(who[close]), owner, texts)
        # Pieces of a text: before the first cut, between cuts, after the last one.
        lead = _leaders(who)
        before = np.insert(places, lead, self.begin[owner[who[lead]]] - length)
        of = np.insert(who, lead, who[lead])
        last = np.append(_leaders(of)[1:], len(of)) - 1
        size = np.append(before[1:], 0) - before if len(of) else before
        if len(of):
            ends = owner[of[last]]
            size[last] = self.begin[ends] + self.size[ends] - before[last]
        if texts:
            of, size = np.concatenate([of, *[np.full(len(x), k) for k, x in texts.items()]]), np.concatenate([size, *texts.values()])
        # Equal sizes of a text together, the earliest first: piece numbers ascend within a text.
        span = int(size.max()) + 1
        both = of * span + size
        order = np.argsort(both, kind="stable")
        both = both[order]
        run = _leaders(both)
        n, at, text = np.diff(np.append(run, len(both))), order[run], both[run] // span
        head = _leaders(text)
        counts = np.diff(np.append(head, len(text)))
        top = n == np.repeat(np.maximum.reduceat(n, head), counts)
        early = np.minimum.reduceat(np.where(top, at, len(size)), head)
        return size[early], np.maximum.reduceat(n, head) / np.add.reduceat(n, head)

    def _apart(self, places: np.ndarray, who: np.ndarray, length: int, tight: np.ndarray, owner: np.ndarray, texts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that a split from the left cuts at; sizes of texts with very many go to ``texts``."""
        lead = _leaders(who)
        end = np.append(lead[1:], len(who))
        following = np.searchsorted(places, places + length)
        keep = np.ones(len(who), bool)
        is_tight = np.zeros(len(lead), bool)
        is_tight[np.searchsorted(who[lead], tight)] = True
        keep[np.repeat(is_tight, end - lead)] = False
        at, stop = lead[is_tight], end[is_tight]
        for _ in range(STEPS):
            keep[at] = True
            at = following[at]
            left = at < stop
            at, stop = at[left], stop[left]
            if not len(at):
                return places[keep], who[keep]
        for k in who[at].tolist():
            seq, p = self.seqs[owner[k]], int(places[lead[np.searchsorted(who[lead], k)]] - self.begin[owner[k]])
            texts[k] = np.array([len(x) for x in seq.split(seq[p : p + length])], np.int64) + length
            keep[who == k] = False
        return places[keep], who[keep]

    def hint_periods(self, depth: int) -> Periods:
        """Period and score of the hint of every length and text, by length."""
        found = []
        for level in self.levels(depth):
            rows = self.hints(level)
            found.append((level.owner[rows].astype(np.int64), np.full(len(rows), level.length), level.first[rows].astype(np.int64), *self.periods(level, rows)))
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return Periods(*[np.concatenate(x) for x in zip(none, *found, strict=True)])

    def cuts(self, depth: int) -> list[tuple[str, float, int]]:
        """Cut, score and period of every text: the period most hints vote for, and its best hint."""
        found = self.hint_periods(depth)
        owner, length, first, period, score = found.owner, found.length, found.first, found.period, found.score
        out = [(s, 0.0, len(s)) for s in self.seqs]
        if not len(owner):
            return out
        span = int(period.max()) + 1
        both = owner * span + period
        order = np.argsort(both, kind="stable")
        vote = both[order]
        run = _leaders(vote)
        best = order[_greatest(vote, score[order])]
        n, shortest, of = np.diff(np.append(run, len(vote))), length[order[run]], vote[run] // span
        # Most votes, then the period of the shortest hint.
        won = _greatest(of, n * (depth + 1) - shortest)
        for k in best[won].tolist():
            i = int(owner[k])
            p = int(first[k] - self.begin[i])
            out[i] = (self.seqs[i][p : p + int(length[k])], float(score[k]), int(period[k]))
        return out


def census(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every k-mer of texts of k characters at least: text and place of its first occurrence, and its count without repeats side by side."""
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(size) - size
    raw = codes("".join(texts))
    letters = np.flatnonzero(np.bincount(raw))
    number = np.zeros(int(letters[-1]) + 1, np.int64)
    number[letters] = np.arange(len(letters))
    letter, code = number[raw], np.zeros(len(raw) - k + 1, np.int64)
    top = 1
    for j in range(k):
        if top * len(letters) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            top = len(distinct)
        code, top = code * len(letters) + letter[j : len(raw) - k + 1 + j], top * len(letters)
    fresh = np.concatenate([[True], code[1:] != code[:-1]])
    fresh[begin] = True
    # Places that run over the end of their text.
    fresh[(begin[1:, None] - np.arange(1, k)).ravel()] = False
    at = np.flatnonzero(fresh)
    code = code[at]
    if top <= 1 << 20:
        n = np.bincount(code, minlength=top)
        first = np.empty(top, np.int64)
        first[code[::-1]] = at[::-1]
        first, n = first[n > 0], n[n > 0]
    else:
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
    owner = np.searchsorted(begin, first, "right") - 1
    return owner, n, first - begin[owner]
