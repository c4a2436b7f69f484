"""Subjects of documents, by class-association rules mined with parallel frequent-pattern growth.

A sentence or line is a transaction of its telling terms, with the label of its document where that has one. Transactions
are dealt to groups of terms, each with the terms before it in the order of frequency (its conditional patterns), and each
group grows the frequent sets that end in its terms, up to the length of a rule. A set that leans to a label is a rule, its
confidence smoothed by its support. A rule is redundant if a part of its terms says the same subject as surely. Sentences
are scored by the log-odds of the matching rules, and the score is calibrated on labelled documents kept out of mining. A
document has the subjects of a fifth of its sentences.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweir.session import cut, shuffle_width

#: The bound of the fit: labelled documents that are used. Terms and rules follow from them and from LEAST_DOCUMENTS alone.
LABELLED_DOCUMENTS = 20_000
#: More rules than that aren't handed to tasks: the fit raises.
RULES = 5_000_000
#: A term or rule has to stand in so many documents of its subject.
LEAST_DOCUMENTS = 3
#: One sentence in so many makes a subject, and the subject of documents that have none.
SHARE_OF, NO_SUBJECT = 5, "general"
#: One labelled document in so many is kept for calibration.
HELD_OUT = 5
#: The order of the model: Han characters of a term, words of a term, terms of a rule.
HAN_TERM, WORD_TERM, RULE_TERMS = 6, 4, 3
#: Counts of terms that a task gathers before it sends them on.
LOCAL_COUNTS = 1_000_000

_HAN = "㐀-鿿〇豈-﫿𠀀-𱍊"
_END = re.compile(rf"[。！？｡．…]+|[.!?]+(?=\s|$|[{_HAN}])|[\r\n]+", re.IGNORECASE)
_RUN = re.compile(rf"[{_HAN}]+|[a-z]+(?:[-'’][a-z]+)*")
_NO_ROOM = re.compile("[­​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")

#: A term with its place: the run of Han characters or of words that it stands in, its start and its end there.
Place = tuple[str, int, int, int]


def units(text: str) -> list[str]:
    """The sentences and lines of a text: compatibility forms and case made plain; those without words left out."""
    found = []
    for part in _END.split(_NO_ROOM.sub("", text)):
        unit = unicodedata.normalize("NFKC", part).lower()
        runs = _RUN.findall(unit)
        if any(len(r) > (1 if r[0] > "z" else 2) for r in runs):
            found.append(unit)
    return found


def terms(unit: str, known: dict[str, float] | None = None) -> list[Place]:
    """Runs of 2 to HAN_TERM Han characters, and of 1 to WORD_TERM words of letters written together: a term is one whether
    its syllables are apart or not. With ``known`` only those."""
    found: list[Place] = []
    words: list[str] = []
    number = 0
    for run in _RUN.findall(unit):
        if run[0] > "z":
            words, number = [], number + 1
            size = len(run)
            found += [(term, number, i, j) for i in range(size - 1) for j in range(i + 2, min(i + HAN_TERM, size) + 1) if known is None or run[i:j] in known for term in (run[i:j],)]
            number += 1
        else:
            words.append(re.sub("[^a-z]", "", run))
            for n in range(1, min(WORD_TERM, len(words)) + 1):
                if len(joined := "".join(words[-n:])) > 2 and (known is None or joined in known):
                    found.append((joined, number, len(words) - n, len(words)))
    return found


def apart(places: list[Place], worth: dict[str, float]) -> list[str]:
    """The terms of a sentence that tell most, each once, none of which overlaps another."""
    chosen: list[Place] = []
    for place in sorted((p for p in places if p[0] in worth), key=lambda p: (-worth[p[0]], p)):
        if all(place[1] != o[1] or place[3] <= o[2] or o[3] <= place[2] for o in chosen) and all(place[0] != o[0] for o in chosen):
            chosen.append(place)
    return [p[0] for p in chosen]


@dataclass(frozen=True)
class Rules:
    """Subjects' priors, how much terms tell, rules as terms -> {subject: log-odds}, and the least score that is right at least half the time."""

    prior: dict[str, float]
    worth: dict[str, float]
    weights: dict[tuple[str, ...], dict[str, float]]
    threshold: float

    def index(self) -> dict[str, list[tuple[tuple[str, ...], dict[str, float]]]]:
        """The rules by their first term; a sentence only meets those of its own terms."""
        found = defaultdict(list)
        for own, weight in self.weights.items():
            found[own[0]].append((own[1:], weight))
        return dict(found)


def best_subject(own: list[str], index: dict) -> tuple[str | None, float]:
    """The subject with the most evidence in a sentence, and its lead over the next: (None, 0) if no rule matches."""
    evidence: dict[str, float] = defaultdict(float)
    for term in own:
        for rest, weight in index.get(term, ()):
            if all(r in own for r in rest):
                for subject, w in weight.items():
                    evidence[subject] += w
    if not evidence:
        return None, 0.0
    ranked = sorted(evidence.items(), key=lambda x: (-x[1], x[0]))
    return ranked[0][0], ranked[0][1] - max(0.0, ranked[1][1] if len(ranked) > 1 else 0.0)


def _labelled(documents: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, subjects) of at most LABELLED_DOCUMENTS labelled documents, the first by hash of their key."""
    own = labels.where(F.col("subject").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    chosen = own.orderBy(F.xxhash64(key), key).limit(LABELLED_DOCUMENTS)
    return documents.select(key, text).where(F.trim(F.col(text)) != "").join(chosen, key)


_MINED = "pmod(xxhash64({key}, 1), {held}) != 0"


def _term_counts(mining: DataFrame) -> DataFrame:
    """(term, subject, n): in how many documents (subject, text) of each subject a term stands."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "subject", "n"])

        for batch in batches:
            for subject, text in zip(batch.column("subject").to_pylist(), batch.column("text").to_pylist()):
                counts.update({(p[0], subject) for unit in units(text) for p in terms(unit)})
                if len(counts) > LOCAL_COUNTS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    local = mining.mapInArrow(count, "term string, subject string, n bigint")
    return local.groupBy("term", "subject").agg(F.sum("n").alias("n"))


def grow(base: dict[tuple[str, ...], Counter], left: int, least: int) -> Iterator[tuple[tuple[str, ...], Counter]]:
    """The frequent sets of conditional patterns, with how often each label has them; at most ``left`` terms each.

    ``base`` has the patterns, each a sequence of terms in the order of frequency, with the labels of its transactions. A set
    is grown by a term, and on in what comes before that term in the patterns that have it."""
    labels: dict[str, Counter] = defaultdict(Counter)
    for pattern, own in base.items():
        for term in pattern:
            labels[term].update(own)
    for term, own in labels.items():
        if own.total() >= least:
            yield (term,), own
            if left > 1:
                before: dict[tuple[str, ...], Counter] = defaultdict(Counter)
                for pattern, counts in base.items():
                    if term in pattern and (rest := pattern[: pattern.index(term)]):
                        before[rest].update(counts)
                for found, counts in grow(before, left - 1, least):
                    yield (*found, term), counts


def frequent_sets(transactions: DataFrame, least: int) -> DataFrame:
    """(terms, subject, n): the frequent sets of transactions (subject, terms in the order of frequency), grown in parallel
    by groups of terms: each group gets, for each of its terms in a transaction, the terms before it."""
    groups = 4 * shuffle_width(transactions.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter((subject, tuple(own)) for subject, own in zip(batch.column("subject").to_pylist(), batch.column("terms").to_pylist()))
            rows = [(zlib.crc32(t.encode()) % groups, t, own[:i], subject, n) for (subject, own), n in counts.items() for i, t in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else ((),) * 5, (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64()))], names=["group", "term", "before", "subject", "n"])

    def mine(table: pa.Table) -> pa.Table:
        bases: dict[str, dict[tuple[str, ...], Counter]] = defaultdict(lambda: defaultdict(Counter))
        for term, before, subject, n in zip(*(table.column(c).to_pylist() for c in ("term", "before", "subject", "n"))):
            bases[term][tuple(before)][subject] += n
        rows = []
        for term, base in bases.items():
            labels = sum(base.values(), Counter())
            if labels.total() >= least:
                found = [((), labels), *(grow(base, RULE_TERMS - 1, least) if RULE_TERMS > 1 else ())]
                rows += [((*own, term), subject, n) for own, counts in found for subject, n in counts.items()]
        return pa.table([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["terms", "subject", "n"])

    dealt = transactions.mapInArrow(deal, "group int, term string, before array<string>, subject string, n bigint")
    return dealt.groupBy("group").applyInArrow(mine, "terms array<string>, subject string, n bigint")


def _surely(k: int, n: int) -> float:
    """Lower bound of the share k / n at two standard errors (Wilson)."""
    z = 4.0
    share = k / n
    return (share + z / (2 * n) - math.sqrt(z * (share * (1 - share) + z / (4 * n)) / n)) / (1 + z / n)


def _telling(counts: list[tuple[str, str, int]], prior: dict[str, float]) -> dict[str, float]:
    """Terms that lean to one subject, with how surely they do."""
    by_term: dict[str, dict[str, int]] = defaultdict(dict)
    for term, subject, n in counts:
        by_term[term][subject] = n
    leaning = {}
    for term, per in by_term.items():
        total = sum(per.values())
        subject, most = max(per.items(), key=lambda x: (x[1] / prior[x[0]], x[0]))
        if most >= LEAST_DOCUMENTS and most / total >= min(0.9, max(0.3, 2 * prior[subject])):
            leaning[term] = _surely(most, total)
    return leaning


def _pruned(rules: dict[tuple[str, ...], dict[str, float]]) -> dict[tuple[str, ...], dict[str, float]]:
    """Without the rules that are redundant: some of their terms say the same subject as surely."""
    kept: dict[tuple[str, ...], dict[str, float]] = {}
    for own in sorted(rules, key=lambda r: (len(r), r)):
        parts = [p for n in range(1, len(own)) for p in combinations(own, n) if p in kept]
        weight = {s: w for s, w in rules[own].items() if all(kept[p].get(s, -math.inf) < w - 0.25 for p in parts)}
        if weight:
            kept[own] = weight
    return kept


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Rules:
    """Rules from the labelled documents, at most LABELLED_DOCUMENTS of them; without labels, no rules.

    The driver gets counts of terms and rules of that bounded sample only, each cut off at LEAST_DOCUMENTS."""
    labelled = cut(_labelled(documents, labels, key, text).select(F.col(key).alias("key"), F.col(text).alias("text"), "subjects").repartition(shuffle_width(documents.sparkSession)))
    mined = F.expr(_MINED.format(key="key", held=HELD_OUT))
    mining = labelled.where((F.size("subjects") == 1) & mined).select(F.col("subjects")[0].alias("subject"), "text")
    found = _term_counts(mining)
    often = found.groupBy("term").agg(F.max("n").alias("most"), F.collect_list(F.struct("subject", "n")).alias("per")).where(F.col("most") >= LEAST_DOCUMENTS)
    counts = [(r.term, p.subject, p.n) for r in often.select("term", "per").toLocalIterator() for p in r.per]
    sizes: Counter = Counter()

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for subject, whole in zip(batch.column("subject").to_pylist(), batch.column("text").to_pylist()):
                own[subject] += len(units(whole))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["subject", "n"])

    for row in mining.mapInArrow(sentences, "subject string, n bigint").collect():
        sizes[row.subject] += row.n
    total = sizes.total()
    if not total:
        return Rules({}, {}, {}, math.inf)
    prior = {s: n / total for s, n in sizes.items() if n}
    worth = _telling(counts, prior)
    often_in: Counter = Counter()
    for term, _, n in counts:
        often_in[term] += n
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((worth, {t: often_in[t] for t in worth}))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, often_in = shared.value
        for batch in batches:
            subjects, items = [], []
            for subject, whole in zip(batch.column("subject").to_pylist(), batch.column("text").to_pylist()):
                for unit in units(whole):
                    if own := apart(terms(unit, worth), worth):
                        subjects.append(subject)
                        items.append(sorted(own, key=lambda t: (-often_in[t], t)))
            yield pa.RecordBatch.from_arrays([pa.array(subjects, pa.string()), pa.array(items, pa.list_(pa.string()))], names=["subject", "terms"])

    per: dict[tuple[str, ...], dict[str, int]] = defaultdict(dict)
    for row in frequent_sets(mining.mapInArrow(choose, "subject string, terms array<string>"), LEAST_DOCUMENTS).toLocalIterator():
        per[tuple(sorted(row.terms))][row.subject] = row.n
    rules = {}
    for own, counts_of in per.items():
        n, weight = sum(counts_of.values()), {}
        for subject, k in counts_of.items():
            if k >= LEAST_DOCUMENTS and 0 < prior[subject] < 1:
                sure = (k + prior[subject]) / (n + 1)
                odds = math.log(sure / (1 - sure)) - math.log(prior[subject] / (1 - prior[subject]))
                if odds > 0.5:
                    weight[subject] = odds
            elif k >= LEAST_DOCUMENTS:
                weight[subject] = 1.0  # the only subject there is
        if weight:
            rules[own] = weight
    kept = _pruned(rules)
    if len(kept) > RULES:
        raise ValueError("too many rules to broadcast")
    in_rules = {t for own in kept for t in own}
    worth = {t: w for t, w in worth.items() if t in in_rules}
    return Rules(prior, worth, kept, _calibrated(labelled.where(~mined), Rules(prior, worth, kept, 0.0)))


def _calibrated(held: DataFrame, rules: Rules) -> float:
    """The least score at which, on the documents kept out, a sentence's subject is among its document's labels at least
    half as often as not; scores are binned by halves."""
    shared = held.sparkSession.sparkContext.broadcast(rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, worth = shared.value.index(), shared.value.worth
        bins: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for whole, subjects in zip(batch.column("text").to_pylist(), batch.column("subjects").to_pylist()):
                for unit in units(whole):
                    subject, lead = best_subject(apart(terms(unit, worth), worth), index)
                    if subject is not None and subject != NO_SUBJECT:
                        own_bin = bins[min(int(2 * lead), 40)]
                        own_bin[0] += 1
                        own_bin[1] += subject in subjects
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int32()), pa.array([n for n, _ in bins.values()], pa.int64()), pa.array([k for _, k in bins.values()], pa.int64())], names=["bin", "n", "hits"])

    scored = held.select("text", "subjects").mapInArrow(score, "bin int, n bigint, hits bigint").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    bins = sorted((r.bin, r.n, r.hits) for r in scored.collect())
    threshold = 0.0
    for at, n, hits in bins:
        if hits / n < 0.5:
            threshold = (at + 1) / 2
        elif n >= 20:
            break
    return threshold


def classify(documents: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject): each subject that a fifth of a document's sentences or lines are about, else NO_SUBJECT.

    Null, empty and blank texts have no rows, nor have texts without any word a subject of their own. Repeated rows each
    have theirs. One narrow stage over whole texts; the rules, RULES at most, are broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(rules)
    kind = documents.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, worth, threshold = shared.value.index(), shared.value.worth, shared.value.threshold
        known: dict[str, str | None] = {}
        for batch in batches:
            rows, subjects = [], []
            for row, whole in enumerate(batch.column(1).to_pylist()):
                if whole is None or not whole.strip():
                    continue
                own: dict[str, int] = defaultdict(int)
                parts = units(whole)
                for unit in parts:
                    if (subject := known.get(unit, "")) == "":
                        subject, lead = best_subject(apart(terms(unit, worth), worth), index)
                        if subject == NO_SUBJECT or lead < threshold:
                            subject = None
                        if len(known) > 100_000:
                            known.clear()
                        known[unit] = subject
                    if subject is not None:
                        own[subject] += 1
                found = sorted(s for s, n in own.items() if n * SHARE_OF >= len(parts)) or [NO_SUBJECT]
                rows += [row] * len(found)
                subjects += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(subjects, pa.string())], names=[key, "subject"])

    return documents.select(key, text).mapInArrow(assign, f"`{key}` {kind}, subject string")
