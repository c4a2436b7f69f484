"""Places of texts among all readings of a code as two words, without a row for each reading."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

#: Most pairs of a cut whose scores are held at once.
BLOCK = 1 << 20


class Lists:
    """Words by code: (code, texts, logarithms of their frequencies); a text has one code."""

    def __init__(self, lists: Iterable[tuple[str, list[str], list[float]]]) -> None:
        self.by_code = {code: (texts, np.array(values, dtype=np.float64)) for code, texts, values in lists}
        self.words = {text: (code, value) for code, (texts, values) in self.by_code.items() for text, value in zip(texts, values.tolist())}
        # Words that go on another by some letters, or end with one behind them: by the codes of both and these letters.
        self.longer: dict[tuple[str, str], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        self.ending: dict[tuple[str, str], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for text, (code, _) in self.words.items():
            for i in range(1, len(text)):
                if (own := self.words.get(text[:i])) is not None:
                    self.longer[own[0], code][text[i:]].append(text[:i])
                if (own := self.words.get(text[i:])) is not None:
                    self.ending[own[0], code][text[:i]].append(text)

    def cuts(self, code: str) -> list[int]:
        return [i for i in range(2, len(code) - 1, 2) if code[:i] in self.by_code and code[i:] in self.by_code]

    def readings(self, code: str, text: str) -> Iterator[tuple[str, str, float, int]]:
        """(first, second, sum of logarithms, cut) of the ways to read a code as two words with this text."""
        for i in range(1, len(text)):
            a, b = self.words.get(text[:i]), self.words.get(text[i:])
            if a and b and a[0] + b[0] == code:
                yield text[:i], text[i:], a[1] + b[1], len(a[0])

    def shared(self, code: str, cuts: list[int]) -> set[str]:
        """The texts that more than one pair of words gives."""
        found = set()
        for i in cuts:
            for j in cuts:
                if (a := self.longer.get((code[:i], code[:j]))) and (b := self.ending.get((code[j:], code[i:]))):
                    found.update(first + second for between in a.keys() & b.keys() for first in a[between] for second in b[between])
        return found


def places(lists: Lists, code: str, asked: list[str], pairs: dict[tuple[str, str], int]) -> list[tuple[str, int, int]]:
    """(text, plain, aware) of the texts ``asked`` that are readings of a code as two words: their places by the words'
    score, and by score and transitions (``pairs``), then by text.

    A text counts once, by its best pair with transitions, then score, then the earlier cut. Texts without transitions that
    only one pair gives have one score in both orders and are counted by it, in arrays; the others are looked at one by one.
    Scores are whole multiples of 1e-9, as they are rounded to nine places."""
    best = {}

    def look(text: str) -> None:
        own = [(math.floor(value * 1e9 + 0.5), pairs.get((first, second), 0), cut) for first, second, value, cut in lists.readings(code, text)]
        if own:
            *_, place = min((-(c := math.floor((s / 1e9 + math.log1p(n)) * 1e9 + 0.5) if n else s), -s, cut, (s, c)) for s, n, cut in own)
            best[text] = (*place, [s for s, _, _ in own])

    for text in asked:
        look(text)
    wanted = list(best)
    if not wanted:
        return []
    cuts = lists.cuts(code)
    for text in {first + second for first, second in pairs} | lists.shared(code, cuts):
        if text not in best:
            look(text)
    bounds = {text: (best[text][0], best[text][1]) for text in wanted}
    before = {(text, k): sum(own[k] > bound or own[k] == bound and other < text for other, own in best.items()) for text, own_bounds in bounds.items() for k, bound in enumerate(own_bounds)}
    # Those looked at one by one leave the counts of arrays, with each of their pairs.
    for text, own_bounds in bounds.items():
        for k, bound in enumerate(own_bounds):
            before[text, k] -= sum(s > bound or s == bound and other < text for other, own in best.items() for s in own[2])
    for cut in cuts:
        (firsts, a), (seconds, b) = lists.by_code[code[:cut]], lists.by_code[code[cut:]]
        step = max(BLOCK // len(b), 1)
        for low in range(0, len(a), step):
            scores = np.floor((a[low : low + step, None] + b) * 1e9 + 0.5)
            for text, own_bounds in bounds.items():
                seen: dict[int, int] = {}
                for k, bound in enumerate(own_bounds):
                    if bound not in seen:
                        i, j = np.nonzero(scores == bound)
                        seen[bound] = int((scores > bound).sum()) + sum(firsts[low + x] + seconds[y] < text for x, y in zip(i.tolist(), j.tolist()))
                    before[text, k] += seen[bound]
    return [(text, before[text, 0] + 1, before[text, 1] + 1) for text in wanted]
