"""A memory that ranks with what was confirmed before: predict, commit, edit, confirm and forget in order, and the report.

Words of a code keep their public share, mixed with the smoothed share of personal evidence; texts that no word of the code
has come in beside them with a bounded mass. Evidence of an entry is its confirmations times the weight of its tier.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from glyphweir.operators.memory import LONG, MEDIUM, PENDING, RECENT, TIER_WEIGHT, Spans

# Limits of what is merged, saturation of evidence, smoothing, and the greatest mass any profile may give.
MOST_COVERED, MOST_MERGED, SATURATION, SMOOTHING, MASS_LIMIT = 8, 50, 4.0, 0.5, 0.10


@dataclass(frozen=True)
class Profile:
    """Share of personal evidence, confirmations before a text comes in, and the mass of such texts."""

    mix: float = 0.25
    confirmations: int = 2
    mass: float = 0.05


# The profiles that are compared.
PROFILES = {"reference": Profile(), "confirmed": Profile(confirmations=3), "lower": Profile(mix=0.10, mass=0.02), "higher": Profile(mix=0.40, mass=0.10)}


class Memory:
    """Pending selections with their places, and confirmed ones with how often and when last."""

    def __init__(self) -> None:
        self.pending: list[list] = []  # start, length, code, text
        self.confirmed: dict[tuple[str, str], list[int]] = {}  # confirmations, generation; in the order of the last one
        self.by_code: dict[str, dict[str, list[int]]] = {}
        self.generations: list[int] = []  # of the confirmed ones, ascending
        self.generation = 0

    def observe(self, start: int, code: str, text: str) -> int:
        """Adds a pending selection; returns how many the bound pushes out."""
        lost = len(self.pending) - PENDING + 1
        if lost > 0:
            del self.pending[:lost]
        self.pending.append([start, len(text), code, text])
        return max(lost, 0)

    def edit(self, start: int, deleted: int, inserted: int) -> tuple[int, int]:
        """(shifted, taken back) pending selections."""
        kept, shifted = [], 0
        for span in self.pending:
            if not Spans.touches(start, deleted, span):
                if span[0] >= start + deleted and inserted != deleted:
                    span[0] += inserted - deleted
                    shifted += 1
                kept.append(span)
        lost, self.pending = len(self.pending) - len(kept), kept
        return shifted, lost

    def confirm(self) -> tuple[int, int]:
        """(confirmed, evicted): the pending ones become the newest entries; beyond LONG the oldest go."""
        for _, _, code, text in self.pending:
            self.generation += 1
            own = self.confirmed.pop((code, text), None)
            if own is None:
                own = [0, 0]
            else:
                del self.generations[bisect_left(self.generations, own[1])]
            self.confirmed[code, text] = own
            own[:] = own[0] + 1, self.generation
            self.generations.append(self.generation)
            self.by_code.setdefault(code, {})[text] = own
        n, self.pending, evicted = len(self.pending), [], 0
        while len(self.confirmed) > LONG:
            self._drop(next(iter(self.confirmed)))
            evicted += 1
        return n, evicted

    def _drop(self, key: tuple[str, str]) -> None:
        del self.generations[bisect_left(self.generations, self.confirmed.pop(key)[1])]
        del self.by_code[key[0]][key[1]]

    def forget(self, code: str, text: str) -> int:
        before = len(self.pending)
        self.pending = [p for p in self.pending if (p[2], p[3]) != (code, text)]
        known = (code, text) in self.confirmed
        if known:
            self._drop((code, text))
        return before - len(self.pending) + known

    def evidence(self, code: str) -> dict[str, tuple[int, int, int]]:
        """Of each confirmed text of a code its weighted evidence, confirmations and generation."""
        own = self.by_code.get(code)
        if not own:
            return {}
        recent, medium = (self.generations[-n] if len(self.generations) >= n else 0 for n in (RECENT, RECENT + MEDIUM))
        return {text: (n * TIER_WEIGHT["recent" if g >= recent else "medium" if g >= medium else "long"], n, g) for text, (n, g) in own.items()}


def merged(memory: Memory, code: str, pool: list[tuple[str, float]], profile: Profile) -> tuple[list[tuple[str, str, float]], float]:
    """(text, source, probability) in order, and the mass of texts that no word of the pool has."""
    return _merged(memory.evidence(code), pool, profile)


def _merged(evidence: dict[str, tuple[int, int, int]], pool: list[tuple[str, float]], profile: Profile) -> tuple[list[tuple[str, str, float]], float]:
    weights = [evidence.get(text, (0,))[0] for text, _ in pool]
    total, mass = sum(weights), sum(w for _, w in pool)
    mix = profile.mix * total / (total + SATURATION)
    ranked = sorted((-((1 - mix) * (weight / mass) + mix * ((own + SMOOTHING) / (total + SMOOTHING * len(pool)))), -weight, place, text) for place, ((text, weight), own) in enumerate(zip(pool, weights)))
    public = {text for text, _ in pool}
    covered = sorted((-w, -n, -g, text) for text, (w, n, g) in evidence.items() if n >= profile.confirmations and text not in public)[:MOST_COVERED]
    extra = -sum(c[0] for c in covered)
    share = profile.mass * extra / (extra + SATURATION) if extra else 0.0
    rows = [(-(1 - share) * -p, 0, place, text, "public") for place, (p, _, _, text) in enumerate(ranked)]
    rows += [(share * w / extra, 1, place, text, "personal") for place, (w, _, _, text) in enumerate(covered)]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    return [(text, source, -value) for value, _, _, text, source in rows[:MOST_MERGED]], share


REPORT = (
    "events", "queries", "oov_queries", "oov_recalled", "top1", "top5", "top10", "improved", "unchanged", "worsened", "first_changes", "displaced", "displacement", "personal_shown", "personal_unwanted", "cap_violations",
    "shifted", "taken_back", "confirmed", "evicted", "forgotten", "pending_left", "confirmed_left",
)


def replay_all(events: Iterable[tuple], profiles: dict[str, Profile]) -> dict[str, dict[str, int]]:
    """The report of events in order under each profile: ("commit", code, text, start, pool), ("edit", start, deleted, inserted),
    ("confirm",) and ("forget", code, text). A commit is predicted before it is learned; a pool is a list (text, weight),
    heaviest first; without one nothing is predicted. Profiles only rank: the memory learns alike under all."""
    memory, learned, ranked = Memory(), Counter(), {name: Counter() for name in profiles}
    for kind, *own in events:
        learned["events"] += 1
        if kind == "commit":
            code, text, start, pool = own
            if pool:
                evidence, found = memory.evidence(code), None
                for name, profile in profiles.items():
                    if evidence or found is None:  # without evidence all profiles rank alike
                        found = _compared(evidence, text, pool, profile)
                    own = ranked[name]
                    for what, n in found.items():
                        own[what] += n
            memory.observe(start, code, text)
        elif kind == "edit":
            shifted, lost = memory.edit(*own)
            learned.update(shifted=shifted, taken_back=lost)
        elif kind == "confirm":
            n, evicted = memory.confirm()
            learned.update(confirmed=n, evicted=evicted)
        else:
            learned["forgotten"] += memory.forget(*own)
    learned.update(pending_left=len(memory.pending), confirmed_left=len(memory.confirmed))
    return {name: {c: learned[c] + own[c] for c in REPORT} for name, own in ranked.items()}


def replay(events: Iterable[tuple], profile: Profile) -> dict[str, int]:
    return replay_all(events, {"": profile})[""]


def _compared(evidence: dict[str, tuple[int, int, int]], text: str, pool: list[tuple[str, float]], profile: Profile) -> dict[str, int]:
    """What one query adds to the report: the merged list against the public one."""
    shown, share = _merged(evidence, pool, profile)
    base = [t for _, _, t in sorted((-w, place, t) for place, (t, w) in enumerate(pool))]
    after = {t: rank for rank, (t, _, _) in enumerate(shown, 1)}
    rank, found = after.get(text), {"queries": 1}
    if text not in base:
        found |= {"oov_queries": 1, "oov_recalled": int(rank is not None)}
    else:
        before, now = base.index(text) + 1, rank or len(shown) + 1
        found["improved" if now < before else "unchanged" if now == before else "worsened"] = 1
    if rank is not None:
        found |= {f"top{k}": int(rank <= k) for k in (1, 5, 10)}
    found["first_changes"] = int(not shown or shown[0][:2] != (base[0], "public"))
    behind = [lost for before, own in enumerate(base, 1) if (lost := after.get(own, len(shown) + 1) - before) > 0]
    personal = [t for t, source, _ in shown if source == "personal"]
    return found | {"displaced": len(behind), "displacement": sum(behind), "personal_shown": len(personal), "personal_unwanted": sum(t != text for t in personal), "cap_violations": int(share > min(profile.mass, MASS_LIMIT))}


# The scenarios, each from an empty memory; a commit has code, text and start, an edit start, deleted, inserted.
_SINGLE, _TWO = [("公开甲", 1.0)], [("公开甲", 0.6), ("公开乙", 0.4)]
SCENARIOS = {
    "stable_repeated_coverage": (_SINGLE, "commit aa 合成丙 0, confirm, commit aa 合成丙 1, confirm, commit aa 合成丙 2, confirm, commit aa 合成丙 3"),
    "retracted_before_confirmation": (_SINGLE, "commit aa 合成丙 0, edit 0 3 0, confirm, commit aa 合成丙 0, edit 0 3 0, confirm, commit aa 合成丙 0"),
    "exact_code_alias_isolation": (_SINGLE, "commit aa 合成丙 0, confirm, commit aa 合成丙 3, confirm, commit bb 合成丙 6"),
    "explicit_forget": (_SINGLE, "commit aa 合成丙 0, confirm, commit aa 合成丙 3, confirm, forget aa 合成丙, commit aa 合成丙 6"),
    "public_reranking": (_TWO, "commit aa 公开乙 0, confirm, commit aa 公开乙 3, confirm, commit aa 公开乙 6"),
    "nonselected_coverage_occupancy": (_SINGLE, "commit aa 合成丙 0, confirm, commit aa 合成丙 3, confirm, commit aa 公开甲 6"),
}


def scenario(name: str) -> list[tuple]:
    pool, text = SCENARIOS[name]
    found = []
    for kind, *own in (part.split() for part in text.split(", ")):
        found.append(("commit", own[0], own[1], int(own[2]), pool) if kind == "commit" else (kind, *map(int, own)) if kind == "edit" else (kind, *own))
    return found
