"""State that later events change: learned spans, tiers of memory, ring buffers, state machines.

Each works on the ordered events of one key (a session, a document), which are bounded by what a session may hold; keys
are many and fold in parallel. What the state would be without retraction is a plain aggregate (see preferences).
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict, namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweir.session import shuffle_width, unfolded

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}

#: Places of the memory's tiers.
PENDING, RECENT, MEDIUM, LONG = 128, 128, 1024, 8192
TIER_WEIGHT = {"recent": 4, "medium": 2, "long": 1}


def fold(events: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple, Iterator[tuple]], list[tuple]], schema: str, lists: DataFrame | None = None) -> DataFrame:
    """Runs ``step`` over each key's events in order, one at a time; what it returns are the rows after the key's columns.

    With ``lists`` (code, pool) an event has the pool of its code. Pools don't go with the events: keys are hashed into parts,
    and a part gets each pool that its codes need once, ahead of its events.

    Rows are hashed by key and sorted within their parts, which spills, and read as a stream: a key with a third of all
    events takes its time but no memory beyond the step's own state."""
    rest = [c for c in events.columns if c not in keys]
    names, n, width = [*keys, *rest], len(keys), shuffle_width(events.sparkSession)
    if lists is None:
        parts = events.select(*names).repartition(width, *keys).sortWithinPartitions(*keys, *order)
    else:
        own = events.select(F.pmod(F.hash(*keys), F.lit(width)).alias("__part"), F.lit(False).alias("__listed"), *names)
        asked = unfolded(own.select("__part", "code").where("code <> ''").groupBy("code").agg(F.collect_set("__part").alias("__parts")))
        pools = asked.join(lists, "code").select(F.explode("__parts").alias("__part"), F.lit(True).alias("__listed"), "code", "pool")
        both = own.unionByName(pools, allowMissingColumns=True).repartition(width, "__part")
        parts = both.sortWithinPartitions("__part", F.desc("__listed"), *keys, *order).select(*names, "__part", "__listed", "pool")

    lists_given = lists is not None

    def with_pools(batches: Iterator[pa.RecordBatch], made: type) -> Iterator[tuple]:
        part, pools, code = None, {}, names.index("code")
        for batch in batches:
            for *values, own, listed, pool in zip(*(column.to_pylist() for column in batch.columns)):
                if own != part:
                    part, pools = own, {}
                if listed:
                    pools[values[code]] = pool
                else:
                    yield made(*values, pools.get(values[code]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([(name, _ARROW[kind]) for name, kind in (part.strip().split(" ") for part in schema.split(","))])
        if lists_given:
            rows = with_pools(batches, namedtuple("Event", [*names, "pool"]))
        else:
            made = namedtuple("Event", names)
            rows = (made(*values) for batch in batches for values in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], field.type) for i, field in enumerate(target)], schema=target)

        for key, own in groupby(rows, key=lambda r: r[:n]):
            out += [(*key, *r) for r in step(key, own)]
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return parts.mapInArrow(run, schema)


class Spans:
    """Words learned at places of a document; an edit takes back those it touches and shifts those behind it."""

    def __init__(self) -> None:
        self.spans: list[list] = []  # start, length, text
        self.counts: dict[str, int] = defaultdict(int)

    def learn(self, start: int, text: str) -> None:
        self.spans.append([start, len(text), text])
        self.counts[text] += 1

    @staticmethod
    def touches(start: int, deleted: int, span: list) -> bool:
        """A deletion touches what it overlaps; a pure insertion only what it falls strictly inside."""
        low, high = span[0], span[0] + span[1]
        return low < start + deleted and start < high if deleted else low < start < high

    def edit(self, start: int, deleted: int, inserted: int) -> int:
        """Applies an edit; returns how many words it took back."""
        kept, lost = [], 0
        for span in self.spans:
            if self.touches(start, deleted, span):
                self.counts[span[2]] -= 1
                lost += 1
                continue
            if span[0] >= start + deleted:
                span[0] += inserted - deleted
            kept.append(span)
        self.spans = kept
        return lost


def retract(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
    """(text, learned, kept) of a segment, which is one document: commits are learned where they were put; revisions take
    words back. A place that is ambiguous teaches a count only and moves nothing."""
    spans, learned = Spans(), defaultdict(int)
    loose: dict[str, int] = defaultdict(int)
    for row in rows:
        inserted, deleted = row.inserted or "", row.deleted or ""
        if row.kind == "Commit":
            if row.reliable:
                spans.edit(row.start, len(deleted), len(inserted))
            if inserted:
                learned[inserted] += 1
                if row.reliable:
                    spans.learn(row.start, inserted)
                else:
                    loose[inserted] += 1
        elif row.reliable:
            spans.edit(row.start, len(deleted), len(inserted))
    return [(text, n, spans.counts.get(text, 0) + loose.get(text, 0)) for text, n in sorted(learned.items())]


class Tiers:
    """Pending selections with their places, and what was confirmed in tiers: the newest recent, then medium, then long."""

    def __init__(self) -> None:
        self.pending: list[list] = []  # start, length, code, text
        self.confirmed: list[tuple[str, str]] = []  # newest first

    def observe(self, start: int, code: str, text: str) -> None:
        if len(self.pending) >= PENDING:
            self.pending.pop(0)
        self.pending.append([start, len(text), code, text])

    def edit(self, start: int, deleted: int, inserted: int) -> None:
        kept = []
        for span in self.pending:
            if Spans.touches(start, deleted, span):
                continue
            if span[0] >= start + deleted:
                span[0] += inserted - deleted
            kept.append(span)
        self.pending = kept

    def confirm(self) -> None:
        self.confirmed = [(c, t) for _, _, c, t in reversed(self.pending)] + self.confirmed
        del self.confirmed[LONG:]
        self.pending = []

    def forget(self, code: str, text: str) -> None:
        self.pending = [p for p in self.pending if (p[2], p[3]) != (code, text)]
        self.confirmed = [c for c in self.confirmed if c != (code, text)]

    def weights(self) -> dict[tuple[str, str], int]:
        found: dict[tuple[str, str], int] = defaultdict(int)
        for place, identity in enumerate(self.confirmed):
            found[identity] += TIER_WEIGHT["recent" if place < RECENT else "medium" if place < RECENT + MEDIUM else "long"]
        return found


def pending_at_end(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
    """(place, code, text) of the selections that a segment has pending at its end, which confirms them, in order."""
    tiers = Tiers()
    for row in rows:
        inserted, deleted = row.inserted or "", row.deleted or ""
        if row.reliable:
            tiers.edit(row.start, len(deleted), len(inserted))
        if row.kind == "Commit" and row.code and inserted and row.reliable:
            tiers.observe(row.start, row.code, inserted)
    return [(place, code, text) for place, (_, _, code, text) in enumerate(tiers.pending)]


def tail_trims(key: tuple, rows: Iterator[tuple], most_gap: int = 5_000) -> list[tuple]:
    """(event_id, committed, left, n_edits) of commits whose end was deleted bit by bit right after them."""
    found, text, start, last, event, edits = [], None, 0, 0, None, 0

    def done() -> None:
        if edits:
            found.append((event, whole, text, edits))

    whole = ""
    for row in rows:
        deleted, inserted = row.deleted or "", row.inserted or ""
        if text and row.kind == "Revision" and row.reliable and deleted and not inserted and 0 <= row.elapsed_ms - last <= most_gap and text.endswith(deleted) and row.start == start + len(text) - len(deleted) and len(deleted) < len(text):
            text, last, edits = text[: -len(deleted)], row.elapsed_ms, edits + 1
            continue
        done()
        text = None
        edits = 0
        if row.kind == "Commit" and row.reliable and inserted:
            text, whole, start, last, event = inserted, inserted, row.start, row.elapsed_ms, row.event_id
    done()
    return found


class Ring:
    """A buffer of bounded size that drops an eighth of its oldest entries at a time."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.size, self.dropped = capacity, [], 0, 0

    def add(self, at: int, size: int) -> None:
        while self.rows and self.size + size > self.capacity:
            for _ in range(max(1, len(self.rows) // 8)):
                self.size -= self.rows.pop(0)[1]
                self.dropped += 1
        if size <= self.capacity:
            self.rows.append((at, size))
            self.size += size


class Recent:
    """The most recent selection of each of the last ``most`` codes."""

    def __init__(self, most: int = 128):
        self.most, self.texts = most, OrderedDict()

    def select(self, code: str, text: str) -> None:
        self.texts.pop(code, None)
        self.texts[code] = text
        while len(self.texts) > self.most:
            self.texts.popitem(last=False)


def composition_steps(keys: list[str]) -> list[tuple[str, str, str]]:
    """(state, code, effect) after each key: idle, composing or paging; effects commit, cancel, page, edit or pass."""
    state, code, out = "idle", "", []
    for key in keys:
        if len(key) == 1 and "a" <= key <= "z":
            state, code, effect = "composing", (code if state != "idle" else "") + key, "edit"
        elif state == "idle":
            effect = "pass"
        elif key == "BS":
            code, effect = code[:-1], "edit"
            state = "composing" if code else "idle"
        elif key in ("PGDN", "PGUP", "TAB"):
            state, effect = "paging", "page"
        elif key == "ESC":
            state, code, effect = "idle", "", "cancel"
        elif key in ("SP", "ENTER") or key.isdigit():
            state, effect = "idle", "commit"
        else:
            effect = "pass"
        out.append((state, code, effect))
        if effect == "commit":
            code = ""
    return out


def painted(gaps: list[int], delay: int) -> tuple[int, int]:
    """(frames painted, frames left out) of keys with these gaps before the next: every second key paints at once, the one
    before it only if the next takes longer than the delay."""
    shown = hidden = 0
    for i, gap in enumerate(gaps):
        if i % 2 or delay <= gap:
            shown += 1
        else:
            hidden += 1
    return shown, hidden


class Coalescer:
    """Paints a frame for each revision of a code: at once if its keys are pairs, else only once the next key is due."""

    def __init__(self, delay: int):
        self.delay, self.active = delay, None

    def input(self, revision: int, n_keys: int, at: int) -> bool:
        """A new revision; whether one that was ready but not painted is left out by it."""
        lost = self.active is not None and self.active["ready"] and not self.active["painted"]
        self.active = {"revision": revision, "odd": n_keys % 2 == 1, "at": at, "due": at + self.delay, "ready": False, "painted": False}
        return lost

    def frame(self, revision: int, at: int) -> str:
        own = self.active
        if own is None or own["revision"] != revision or at < own["at"]:
            return "stale"
        if own["painted"]:
            return "painted"
        own["ready"] = True
        if own["odd"] and at < own["due"]:
            return "deferred"
        own["painted"] = True
        return "paint"

    def timer(self, at: int) -> bool:
        """Whether a ready odd frame is painted now that its deadline has passed."""
        own = self.active
        if own is None or own["painted"] or not own["ready"] or not own["odd"] or at < own["due"]:
            return False
        own["painted"] = True
        return True

    def force(self) -> bool:
        """Paints a ready frame whatever its deadline."""
        own = self.active
        if own is None or own["painted"] or not own["ready"]:
            return False
        own["painted"] = True
        return True

    def cancel(self) -> None:
        self.active = None


def coalesced(sizes: list[int], gap: int, takes: int, delay: int) -> tuple[int, int, int]:
    """(at once, by timer, never): how the keys of codes of these sizes, ``gap`` apart, are painted if a frame takes so long;
    a code's end forces what is left."""
    at_once = by_timer = never = revision = 0
    for size in sizes:
        own, at = Coalescer(delay), 0
        for n in range(1, size + 1):
            revision += 1
            never += own.input(revision, n, at)
            at_once += own.frame(revision, at + takes) == "paint"
            at += gap
            if n < size:
                by_timer += own.timer(at - 1)
        by_timer += own.force()
    return at_once, by_timer, never


class KeyBuffer:
    """The keys since the last change of a text; one more than ``most`` empties it, and then they are not complete."""

    def __init__(self, most: int = 128):
        self.most, self.keys, self.complete, self.resets = most, [], True, 0

    def observe(self, key: str) -> bool:
        reset = len(self.keys) == self.most
        if reset:
            self.keys, self.complete, self.resets = [], False, self.resets + 1
        self.keys.append(key)
        return reset


def slots(actions: Iterator[tuple[str, str]]) -> tuple[str | None, str | None, str | None]:
    """(current, candidate, previous) after adopt, stage, promote and rollback; an action that isn't allowed changes nothing."""
    current = candidate = previous = None
    for action, package in actions:
        if action == "adopt" and current is None:
            current = package
        elif action == "stage" and current is not None and package not in (current, previous):
            candidate = package
        elif action == "promote" and candidate is not None:
            current, candidate, previous = candidate, None, current
        elif action == "rollback" and previous is not None:
            current, previous = previous, current
    return current, candidate, previous
