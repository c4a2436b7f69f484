"""Sentences for unsegmented key codes: word edges by equi-join, then the k best paths of each code.

The edges of a code are few (its length times the words kept per span), so a group is bounded by the length of a code.
Paths are folded from the end of a code to its start. A code of any length is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweir.functions.codec import conservative_tail
from glyphweir.functions.scoring import ABBREVIATION_COST, BIGRAM_SHARE, CORRECTION_COST, LITERAL_COST, SMOOTHING, UNIGRAM_SHARE, correction_rank, word_score
from glyphweir.operators.lexicon import first_by, ranked, spelling_table
from glyphweir.operators.noisy import matches
from glyphweir.operators.sieve import filter_of, passes
from glyphweir.session import cut, shuffle_width, shuffled, unfolded

#: Longest spelling: twelve syllables of two keys.
SPELLING_LIMIT = 24
PATH = "observed string, rank int, text string, segments array<string>, unresolved int, used_error boolean, score double"


def spans(codes: DataFrame, even: bool) -> DataFrame:
    """(observed, low, high, piece): the parts of each distinct code of ``observed`` that a word may spell."""
    n = F.length("observed")
    own = codes.select("observed").where(n > 0).distinct()
    if even:
        own = own.where(n % 2 == 0)
    step = 2 if even else 1
    lows = own.select("observed", F.explode(F.sequence(F.lit(0), n - step, F.lit(step))).alias("low"))
    highs = F.sequence(F.col("low") + step, F.least(n, F.col("low") + SPELLING_LIMIT), F.lit(step))
    return unfolded(lows.select("observed", "low", F.explode(highs).alias("high")).withColumn("piece", F.substring("observed", F.col("low") + 1, F.col("high") - F.col("low"))))


def exact_edges(codes: DataFrame, words: DataFrame, keep: int | None = None) -> DataFrame:
    """Edges of full codes at even places: (observed, low, high, text, code, frequency); the ``keep`` best of a span."""
    own = words.select("text", "code", "frequency")
    if keep is not None:  # a span's words are those of its code, so they are ranked in the lexicon and not for every span
        own = ranked(own, ["code"], F.desc("frequency"), F.asc("text"), limit=keep, name="edge_rank").drop("edge_rank")
    return spans(codes, True).join(own, F.col("piece") == F.col("code")).drop("piece")


def shortcut_edges(codes: DataFrame, words: DataFrame, keep: int) -> DataFrame:
    """Full-code edges at even places and, at the end of a code only, words of two syllables or more by their conservative tail."""
    parts = spans(codes, False).where("low % 2 = 0")
    full = words.select("text", "code", "frequency", F.lit(False).alias("final"))
    short = words.where(F.size("codes") > 1).select("text", conservative_tail(F.col("codes")).alias("code"), "frequency", F.lit(True).alias("final"))
    edges = parts.join(full.unionByName(short), F.col("piece") == F.col("code")).where(~F.col("final") | (F.col("high") == F.length("observed")))
    once = first_by(edges, ["observed", "low", "high", "final", "text"], F.desc("frequency"))
    return ranked(once, ["observed", "low", "high", "final"], F.desc("frequency"), F.asc("text"), limit=keep, name="edge_rank").drop("edge_rank", "final", "piece")


def fixed_paths(segments: list[list[tuple[str, float]]], keep: int) -> list[tuple[float, str]]:
    """The ``keep`` best (cost, text) of words chosen segment by segment; ``segments`` has the (text, log-probability) of each."""
    paths = [(0.0, "")]
    for own in segments:
        best: dict[str, float] = {}
        for cost, text in paths:
            for word, value in own:
                whole = round(cost - value, 9)
                if whole < best.get(text + word, math.inf):
                    best[text + word] = whole
        paths = sorted((c, t) for t, c in best.items())[:keep]
    return paths


def noisy_edges(codes: DataFrame, words: DataFrame, keep: int | None, corrections: bool = True) -> DataFrame:
    """Edges of all spellings, in full or short, and with one edit: adds abbreviated, kind, spelling and beaten.

    Each distinct part is looked up once, and what is found for it stays in its task from there on. Of an entry the best clean and the best corrected spelling stay; a clean one that
    the corrected one beats is ``beaten`` and serves only once the error is spent, and a corrected one that the clean one
    beats serves never. Of a span the ``keep`` best texts stay among the clean edges, among those not beaten and among the
    corrected ones, and apart from them the ``keep`` best that the recovery lane may use: swaps, and clean edges, in full or
    with an anchored suffix. This loses no path among the best ``keep`` of a lane as long as scores don't depend on the word
    before; without ``keep`` all edges stay."""
    every = spans(codes, False)
    pieces = every.select(F.col("piece").alias("observed"))
    if corrections:
        found = matches(pieces, words).drop("score").repartition("observed").withColumn("score", word_score(F.col("frequency"), F.col("kind"), F.col("abbreviated")))
    else:
        found = unfolded(spelling_table(words)).join(pieces.distinct().withColumnRenamed("observed", "spelling"), "spelling").withColumn("observed", F.col("spelling")).withColumn("kind", F.lit("exact"))
        found = found.withColumn("score", F.round(F.ln("frequency") - ABBREVIATION_COST * F.col("abbreviated"), 9))
    clean = F.col("kind") == "exact"
    place = F.struct((-F.col("score")).alias("cost"), "abbreviated", correction_rank(F.col("kind")).alias("likelihood"), "spelling", "kind")
    entries = found.groupBy("observed", "text", "code", "frequency").agg(F.min(F.when(clean, place)).alias("exact"), F.min(F.when(~clean, place)).alias("edited"))
    beaten = F.coalesce(F.col("edited") < F.col("exact"), F.lit(False))
    both = F.array(F.struct(F.col("exact").alias("own"), beaten.alias("beaten")), F.struct(F.when(F.col("exact").isNull() | beaten, F.col("edited")).alias("own"), F.lit(False).alias("beaten")))
    best = entries.select("observed", "text", "code", "frequency", F.inline(F.filter(both, lambda e: e["own"].isNotNull()))).select("*", "own.*").drop("own")
    if keep is not None:
        order = [F.asc("cost"), F.asc("text"), F.asc("abbreviated"), F.asc("likelihood"), F.asc("spelling"), F.asc("code")]
        layers = F.when(~clean, F.array(F.lit("edited"))).when(F.col("beaten"), F.array(F.lit("spent"))).otherwise(F.array(F.lit("spent"), F.lit("unspent")))
        texts = first_by(best.withColumn("layer", F.explode(layers)), ["observed", "layer", "text"], *order)
        apart = (clean | (F.col("kind") == "swap")) & is_anchored_suffix(F.col("code"), F.col("abbreviated"), F.col("spelling"))
        turns = texts.withColumn("layer", F.explode(F.when(apart, F.array(F.col("layer"), F.concat("layer", F.lit(" apart")))).otherwise(F.array("layer"))))
        best = ranked(turns, ["observed", "layer"], *order, limit=keep, name="edge_rank").dropDuplicates(["observed", "text", "code", "kind"])
    return every.join(best.select(F.col("observed").alias("piece"), "text", "code", "frequency", "abbreviated", "kind", "spelling", "beaten"), "piece").drop("piece")


@dataclass(frozen=True)
class Model:
    """Word transitions: counts of pairs, totals of the first words, number of words."""

    pairs: dict[tuple[str, str], int]
    totals: dict[str, int]
    size: int

    def log(self, before: str, word: str) -> float:
        return math.log((self.pairs.get((before, word), 0) + SMOOTHING) / (self.totals.get(before, 0) + SMOOTHING * self.size))


def steps_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(observed, pairs, totals): of the transitions ``pairs`` (prev, cur, n) those between edges of a code that meet, and
    the totals of their first words. Three shuffles by key; no table is handed to tasks whole."""
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("total"))
    words = edges.select("observed", "low", "high", "text").distinct()
    meets = words.select("observed", F.col("high").alias("place"), F.col("text").alias("prev")).distinct().join(words.select("observed", F.col("low").alias("place"), F.col("text").alias("cur")).distinct(), ["observed", "place"])
    known = meets.select("observed", "prev", "cur").distinct().join(pairs, ["prev", "cur"]).groupBy("observed").agg(F.collect_list(F.struct("prev", "cur", "n")).alias("pairs"))
    firsts = words.select("observed", F.col("text").alias("prev")).distinct().join(totals, "prev").groupBy("observed").agg(F.collect_list(F.struct("prev", "total")).alias("totals"))
    return firsts.join(known, "observed", "left")


class Path(NamedTuple):
    """One way to read a code; the first fields are its order: unresolved keys, error, score, words, text."""

    unresolved: int
    used_error: bool
    cost: float
    n_words: int
    text: str
    texts: tuple[str, ...]
    codes: tuple[str, ...]
    anchored: bool
    swapped: bool
    score: float

    def order(self) -> tuple:
        return self[:7]

    def lane(self) -> str:
        if not self.used_error:
            return "exact"
        return "recovery" if self.anchored and self.swapped and not self.unresolved else "error"


def anchored_suffix(code: str, spelling: str) -> bool:
    """Whether a spelling has the first syllables in full and only first keys after them (or is the full code)."""
    n, short = len(code) // 2, len(code) - len(spelling)
    if short < 0 or short >= n:
        return False
    full = n - short
    return spelling == code[: 2 * full] + code[2 * full :: 2]


def is_anchored_suffix(code: Column, abbreviated: Column, spelling: Column) -> Column:
    """The same for a spelling with so many syllables ``abbreviated``."""
    full = F.length(code) - 2 * abbreviated
    return (full > 0) & (spelling == F.concat(F.left(code, full), F.regexp_replace(F.substring(code, full + 1, F.length(code)), "(.).", "$1")))


def best_paths(observed: str, edges: list[dict], total: int, keep: int, per_text: int = 1, literals: bool = True, model: Model | None = None) -> list[Path]:
    """The best paths of one code, at most ``keep`` texts per lane and ``per_text`` segmentations of a text.

    An edge that is corrected uses the one error of a sentence. A literal key costs LITERAL_COST, spends no error and
    resets the word before. Of one entry over one span the better of its exact and corrected spellings counts."""
    size = len(observed)
    at: list[list[dict]] = [[] for _ in range(size)]
    befores: list[set[str]] = [{""} for _ in range(size + 1)]
    corrected = False
    for edge in edges:
        at[edge["low"]].append(edge)
        corrected |= edge.get("kind", "exact") != "exact"
        if model:
            befores[edge["high"]].add(edge["text"])
    end = [Path(0, False, 0.0, 0, "", (), (), True, False, 0.0)]
    # By place, whether the error is spent, and the word before (one for all without a model).
    best: list[dict[tuple[bool, str], list[tuple]]] = [{} for _ in range(size)]
    best.append({(used, before): end for used in (False, True) for before in befores[size]})

    def usable(place: int, used: bool) -> list[tuple]:
        """(high, text, code, own score, cost, spent, anchored, swapped): by entry and span the better of the exact and the
        corrected spellings while the error is unspent, else the exact one."""
        found: dict[tuple, tuple] = {}
        for edge in at[place]:
            kind, short = edge.get("kind", "exact"), edge.get("abbreviated", 0)
            if kind != "exact" if used else edge.get("beaten", False):
                continue
            own, cost = math.log(edge["frequency"] / total), ABBREVIATION_COST * short + CORRECTION_COST[kind]
            identity, rank = (edge["high"], edge["text"], edge["code"]), (round(cost - own, 9), short, kind != "exact")
            if identity not in found or rank < found[identity][0]:
                found[identity] = (rank, (*identity, own, cost, kind != "exact", anchored_suffix(edge["code"], edge.get("spelling", edge["code"])), kind == "swap"))
        return [edge for _, edge in found.values()]

    def kept(paths: list[tuple]) -> list[tuple]:
        """The best of each lane in order; the same cut of a text once, ``per_text`` cuts of it, ``keep`` texts."""
        paths.sort()
        seen, texts, lanes, out = set(), {}, {}, []
        for path in paths:
            cut, text = (path[5], path[6]), path[4]
            if cut in seen or texts.get(text, 0) >= per_text:
                continue
            lane = lanes.setdefault(2 if not path[1] else 1 if path[7] and path[8] and not path[0] else 0, set())
            if text not in lane and len(lane) >= keep:
                continue
            seen.add(cut)
            texts[text] = texts.get(text, 0) + 1
            lane.add(text)
            out.append(path)
        return out

    for place in range(size - 1, -1, -1):
        for used in (False, True) if corrected else (False,):
            own_edges = usable(place, used)
            for before in befores[place]:
                found: list[tuple] = []
                for high, text, code, own, cost, spent, anchored, swapped in own_edges:
                    if model and before:
                        own = UNIGRAM_SHARE * own + BIGRAM_SHARE * model.log(before, text)
                    score = own - cost
                    for rest in best[high].get((used or spent, text if model else ""), ()):
                        whole = score + rest[9]
                        found.append((rest[0], spent or rest[1], -round(whole, 9), rest[3] + 1, text + rest[4], (text, *rest[5]), (code, *rest[6]), anchored and rest[7], swapped or rest[8], whole))
                if literals:
                    text = f"〔{observed[place]}〕"
                    for rest in best[place + 1].get((used, ""), ()):
                        whole = rest[9] - LITERAL_COST
                        found.append((rest[0] + 1, rest[1], -round(whole, 9), rest[3] + 1, text + rest[4], (text, *rest[5]), ("", *rest[6]), False, rest[8], whole))
                best[place][used, before] = kept(found)
    return [Path(*p) for p in best[0][False, ""]] if size else []


def one_lane_paths(observed: str, edges: list[dict], total: int, keep: int, literals: bool = False, model: Model | None = None) -> list[Path]:
    """best_paths for exact edges: the best ``keep`` texts, each by its best cut.

    No error is spent, so there is one lane, and a state is a place and, with a model, the word before. A path is carried as
    (unresolved, cost, words, text, first text, other texts, first code, other codes, score): its order, and its parts are
    only joined once it is kept."""
    size = len(observed)
    at: list[list[tuple]] = [[] for _ in range(size)]
    befores: list[set[str]] = [{""} for _ in range(size + 1)]
    for edge in edges:
        at[edge["low"]].append((edge["high"], edge["text"], edge["code"], math.log(edge["frequency"] / total)))
        if model:
            befores[edge["high"]].add(edge["text"])
    end = [(0, 0.0, 0, "", (), (), 0.0)]  # unresolved, cost, words, text, texts, codes, score
    best: list[dict[str, list[tuple]]] = [{} for _ in range(size)]
    best.append(dict.fromkeys(befores[size], end))
    for place in range(size - 1, -1, -1):
        own_edges = at[place]
        literal = f"〔{observed[place]}〕"
        for before in befores[place]:
            found = []
            if model and before:
                counts, below = model.pairs, model.totals.get(before, 0) + SMOOTHING * model.size
                unseen = math.log(SMOOTHING / below)
            for high, text, code, own in own_edges:
                if model and before:
                    n = counts.get((before, text))
                    own = UNIGRAM_SHARE * own + BIGRAM_SHARE * (math.log((n + SMOOTHING) / below) if n else unseen)
                for unresolved, _, words, rest, texts, codes, score in best[high].get(text if model else "", ()):
                    whole = own + score
                    found.append((unresolved, -round(whole, 9), words + 1, text + rest, text, texts, code, codes, whole))
            if literals:
                for unresolved, _, words, rest, texts, codes, score in best[place + 1].get("", ()):
                    whole = score - LITERAL_COST
                    found.append((unresolved + 1, -round(whole, 9), words + 1, literal + rest, literal, texts, "", codes, whole))
            found.sort()
            kept: dict[str, tuple] = {}
            for unresolved, cost, words, text, first, texts, code, codes, score in found:
                if text not in kept:
                    kept[text] = (unresolved, cost, words, text, (first, *texts), (code, *codes), score)
                    if len(kept) == keep:
                        break
            best[place][before] = list(kept.values())
    return [Path(unresolved, False, cost, words, text, texts, codes, not unresolved, False, score) for unresolved, cost, words, text, texts, codes, score in best[0][""]] if size else []


def boundary_paths(size: int, edges: dict[tuple[int, int], list[str]], keep: int) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """For each place of a code of ``size`` syllables the ``keep`` best ways to read what is before it and what is after it as words.

    ``edges`` has the texts of each span, best first. A path is (number of words, negative lengths, ranks, text), which is its
    order: fewer words, longer ones first, better ranks, text."""

    def best(paths: list[tuple]) -> list[tuple]:
        texts: dict[str, tuple] = {}
        for path in sorted(paths):
            texts.setdefault(path[3], path)
        return list(texts.values())[:keep]

    prefixes, suffixes = ([[] for _ in range(size)] for _ in range(2))
    prefixes.insert(0, [(0, (), (), "")])
    suffixes.append([(0, (), (), "")])
    for place in range(1, size + 1):
        prefixes[place] = best([(n + 1, (*sizes, low - place), (*ranks, k), text + word) for low in range(place) for k, word in enumerate(edges.get((low, place), ())) for n, sizes, ranks, text in prefixes[low]])
        low = size - place
        suffixes[low] = best([(n + 1, (low - high, *sizes), (k, *ranks), word + text) for high in range(low + 1, size + 1) for k, word in enumerate(edges.get((low, high), ())) for n, sizes, ranks, text in suffixes[high]])
    return prefixes, suffixes


def compositions(size: int, core: dict[tuple[int, int], list[str]], added: dict[tuple[int, int], list[tuple[int, str]]], keep: int, top: int) -> list[tuple[str, str]]:
    """The ``top`` (text, added word) with one added word, given as (rank, text) by span, between core paths."""
    prefixes, suffixes = boundary_paths(size, core, keep)
    found = [
        (low - high, a[0] + b[0], rank, a[2] + b[2], low, a[3] + word + b[3], word)
        for (low, high), own in added.items() if high - low < size
        for rank, word in own for a in prefixes[low] for b in suffixes[high]
    ]
    texts: dict[str, str] = {}
    for *_, text, word in sorted(found):
        texts.setdefault(text, word)
    return list(texts.items())[:top]


def sentences(edges: DataFrame, words: DataFrame, top: int = 5, per_text: int = 1, literals: bool = False, model: Model | None = None, codes: DataFrame | None = None, spelled: bool = False, transitions: DataFrame | None = None, size: int = 1) -> DataFrame:
    """(observed, rank, text, segments, unresolved, used_error, score) of the ``top`` paths of each code.

    ``spelled`` adds the codes of the segments.

    With ``literals`` pass ``codes`` too: a code without any edge still has its literal path. The sum of frequencies is a
    scalar. ``model`` is handed to tasks and its size checked by the caller who fits it; ``transitions``, a table (prev, cur,
    n) with the number of words ``size``, takes its place at any size: each code gets those between its own edges."""
    total = int(words.agg(F.coalesce(F.sum("frequency"), F.lit(1))).first()[0])
    optional = [c for c in ("abbreviated", "kind", "spelling", "beaten") if c in edges.columns]
    fields = ["low", "high", "text", "code", "frequency", *optional]
    # The number of parts is set: adaptive coalescing by bytes would leave the paths to a task or two.
    grouped = edges.repartition(shuffle_width(edges.sparkSession), "observed").groupBy("observed").agg(F.collect_list(F.struct(*fields)).alias("edges"))
    if codes is not None:
        own = codes.select("observed").where(F.length("observed") > 0).distinct()
        grouped = own.join(shuffled(grouped), "observed", "left")
    if transitions is not None:
        grouped = grouped.join(shuffled(steps_of(edges, transitions)), "observed", "left")
    shared = edges.sparkSession.sparkContext.broadcast(model)
    with_steps = transitions is not None
    one_lane = not optional and per_text == 1
    keep = max(2 * top, 20) if "kind" in edges.columns else top  # without corrections there is one lane, and the best texts of a state suffice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            known = [None] * batch.num_rows if not with_steps else [Model({(p["prev"], p["cur"]): p["n"] for p in pairs or ()}, {t["prev"]: t["total"] for t in totals or ()}, size) for pairs, totals in zip(batch.column("pairs").to_pylist(), batch.column("totals").to_pylist())]
            for observed, lists, steps in zip(batch.column("observed").to_pylist(), batch.column("edges"), known):
                own = lists.as_py()  # one code's edges at a time
                known_steps = steps or shared.value
                paths = one_lane_paths(observed, own or [], total, keep, literals, known_steps) if one_lane else best_paths(observed, own or [], total, keep, per_text, literals, known_steps)
                for rank, path in enumerate(paths[:top], 1):
                    rows.append({"observed": observed, "rank": rank, "text": path.text, "segments": list(path.texts), "unresolved": path.unresolved, "used_error": path.used_error, "score": round(path.score, 6)} | ({"codes": list(path.codes)} if spelled else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("observed", pa.string()), ("rank", pa.int32()), ("text", pa.string()), ("segments", pa.list_(pa.string())), ("unresolved", pa.int32()), ("used_error", pa.bool_()), ("score", pa.float64()), *([("codes", pa.list_(pa.string()))] if spelled else [])]))

    columns = ["observed", "edges"] + ["pairs", "totals"] * with_steps
    return grouped.select(*columns).mapInArrow(run, PATH + ", codes array<string>" * spelled)


def full_and_shortcut(codes: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """(mode, observed, rank, text, score) of the ``top`` readings of distinct codes as any number of words in full code (full),
    where the last may lack its last key (shortcut).

    A full code has an even number of keys and a conservative tail an odd one, so codes of an even length read alike in both modes
    and the others in one. Parts are made once for both; only those that may be words leave their task, and the
    words of a part stay in one list."""
    full = words.select(F.col("code").alias("piece"), "text", "frequency")
    short = words.where(F.size("codes") > 1).groupBy(conservative_tail(F.col("codes")).alias("piece"), "text").agg(F.max("frequency").alias("frequency"))
    best = ranked(full.unionByName(short), ["piece"], F.desc("frequency"), F.asc("text"), limit=top, name="place")
    in_order = F.sort_array(F.collect_list(F.struct("place", F.concat(F.col("frequency").cast("string"), F.lit(" "), "text").alias("word"))))
    lists = cut(best.groupBy("piece").agg(in_order["word"].alias("own")))  # read twice
    n = F.length("observed")
    lows = codes.select("observed").where(n > 0).select("observed", F.explode(F.sequence(F.lit(0), n - 1, F.lit(2))).alias("low"))
    rest = n - F.col("low")
    sizes = F.sequence(F.lit(2), F.greatest(F.least(rest, F.lit(SPELLING_LIMIT)), F.lit(2)), F.lit(2))
    sizes = F.when((rest % 2 == 1) & (rest < SPELLING_LIMIT), F.concat(sizes, F.array(rest))).otherwise(sizes)
    parts = lows.select("observed", "low", F.explode(sizes).alias("size")).select("observed", "low", F.substring("observed", F.col("low") + 1, F.col("size")).alias("piece"))
    found = unfolded(parts.where(passes(filter_of(lists.select("piece"), lists), F.col("piece")))).join(shuffled(lists), "piece")
    rows = found.select("observed", "low", (F.col("low") + F.length("piece")).alias("high"), "own")
    # The number of parts is set: adaptive coalescing by bytes would leave the paths to a task or two.
    grouped = rows.repartition(shuffle_width(codes.sparkSession), "observed").groupBy("observed").agg(F.collect_list(F.struct("low", "high", "own")).alias("parts"))
    total = int(words.agg(F.coalesce(F.sum("frequency"), F.lit(1))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for observed, own in zip(batch.column("observed").to_pylist(), batch.column("parts")):
                edges = []
                for part in own.as_py():  # one code's edges at a time
                    low, high = part["low"], part["high"]
                    for word in part["own"]:
                        frequency, _, text = word.partition(" ")
                        edges.append({"low": low, "high": high, "text": text, "code": observed[low:high], "frequency": int(frequency)})
                rows += [(observed, rank, path.text, round(path.score, 6)) for rank, path in enumerate(one_lane_paths(observed, edges, total, top), 1)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.float64()))], names=["observed", "rank", "text", "score"])

    read = grouped.mapInArrow(run, "observed string, rank int, text string, score double")
    modes = F.when(n % 2 == 0, F.array(F.lit("full"), F.lit("shortcut"))).otherwise(F.array(F.lit("shortcut")))
    return read.select(F.explode(modes).alias("mode"), "observed", "rank", "text", "score")


def lanes(edges: DataFrame, words: DataFrame, top: int = 5) -> DataFrame:
    """(observed, lane, rank, text, score): the best paths, and apart from them the recovered swaps with other texts."""
    total = int(words.agg(F.coalesce(F.sum("frequency"), F.lit(1))).first()[0])
    grouped = edges.repartition(shuffle_width(edges.sparkSession), "observed").groupBy("observed").agg(F.collect_list(F.struct("low", "high", "text", "code", "frequency", "abbreviated", "kind", "spelling", "beaten")).alias("edges"))
    keep = max(2 * top, 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for observed, lists in zip(batch.column("observed").to_pylist(), batch.column("edges")):
                paths = best_paths(observed, lists.as_py(), total, keep)
                primary = paths[:top]
                texts = {p.text for p in primary}
                recovered = [p for p in paths if p.lane() == "recovery" and p.text not in texts][:top]
                for lane, some in (("primary", primary), ("recovery", recovered)):
                    rows += [{"observed": observed, "lane": lane, "rank": i, "text": p.text, "score": round(p.score, 6)} for i, p in enumerate(some, 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("observed", pa.string()), ("lane", pa.string()), ("rank", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))

    return grouped.mapInArrow(run, "observed string, lane string, rank int, text string, score double")
