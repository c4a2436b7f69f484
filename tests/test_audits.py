import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphweir.operators import adaptive as A
from glyphweir.operators import lattice, lexicon, noisy, snapshots
from glyphweir.operators import memory as M
from glyphweir.plans import audits

SELECTION = "created bigint, process string, sequence int, number string, code string, text string"


def test_scenarios():
    report = {(s, p): A.replay(A.scenario(s), profile) for s in A.SCENARIOS for p, profile in A.PROFILES.items()}
    recalled = {s: [report[s, p]["oov_recalled"] for p in A.PROFILES] for s in A.SCENARIOS}
    assert recalled["stable_repeated_coverage"] == [2, 1, 2, 2]
    assert recalled["retracted_before_confirmation"] == recalled["exact_code_alias_isolation"] == recalled["explicit_forget"] == [0] * 4
    assert [report["retracted_before_confirmation", p]["taken_back"] for p in A.PROFILES] == [2] * 4
    assert [report["explicit_forget", p]["forgotten"] for p in A.PROFILES] == [1] * 4
    assert [report["public_reranking", p]["improved"] for p in A.PROFILES] == [report["public_reranking", p]["top1"] for p in A.PROFILES] == [0, 0, 0, 2]
    assert [report["nonselected_coverage_occupancy", p]["personal_unwanted"] for p in A.PROFILES] == [1, 0, 1, 1]
    assert not any(r["cap_violations"] or r["evicted"] for r in report.values())
    assert [len(A.scenario(s)) for s in A.SCENARIOS] == [7, 7, 5, 6, 5, 5]


def test_the_memory_evicts_the_oldest(monkeypatch):
    monkeypatch.setattr(A, "LONG", 3)
    memory = A.Memory()
    for i, text in enumerate("abcad"):
        memory.observe(i, "x", text)
        memory.confirm()
    assert list(memory.confirmed) == [("x", "c"), ("x", "a"), ("x", "d")] and set(memory.by_code["x"]) == set("cad")
    assert memory.evidence("x")["a"][1] == 2 and memory.forget("x", "a") == 1 and memory.forget("x", "a") == 0


def test_generations_stay_in_order(monkeypatch):
    """Tiers by generations kept in order are those of all confirmed entries sorted, under commits, edits, evictions and forgetting."""
    for name, n in (("RECENT", 3), ("MEDIUM", 4), ("LONG", 12)):
        monkeypatch.setattr(A, name, n)
    rnd, memory = random.Random(2), A.Memory()
    for _ in range(2_000):
        match rnd.randrange(6):
            case 0:
                memory.confirm()
            case 1:
                memory.forget(rnd.choice("xyz"), rnd.choice("abcdefg"))
            case 2:
                memory.edit(rnd.randrange(20), rnd.randrange(3), rnd.randrange(3))
            case _:
                memory.observe(rnd.randrange(20), rnd.choice("xyz"), rnd.choice("abcdefg"))
        newest = sorted((g for _, g in memory.confirmed.values()), reverse=True)
        assert memory.generations == newest[::-1]
        recent, medium = (newest[n - 1] if len(newest) >= n else 0 for n in (3, 7))
        for code in "xyz":
            want = {t: (n * (4 if g >= recent else 2 if g >= medium else 1), n, g) for (c, t), (n, g) in memory.confirmed.items() if c == code}
            assert memory.evidence(code) == want


def test_profiles_rank_once_without_evidence(monkeypatch):
    """Of a code without evidence one ranking serves all profiles; with evidence each has its own, and the reports stay those of replays apart."""
    calls = []
    own = A._merged
    monkeypatch.setattr(A, "_merged", lambda evidence, pool, profile: calls.append(profile) or own(evidence, pool, profile))
    pool = [("甲", 3.0), ("乙", 1.0)]
    events = [("commit", "aa", "乙", 0, pool), ("commit", "aa", "丙", 1, pool), ("confirm",), ("commit", "aa", "乙", 2, pool)]
    got = A.replay_all(events, A.PROFILES)
    assert len(calls) == 1 + 1 + len(A.PROFILES)
    assert got == {name: A.replay(events, profile) for name, profile in A.PROFILES.items()}


def test_pools_of_a_fold_go_once_to_a_part(spark, small):
    """Each event has the pool of its code, whether codes have one or not, and pools are not joined to the events."""
    events = spark.createDataFrame([(f"s{i % 7}", i, f"c{i % 5}" if i % 11 else None) for i in range(200)], "session_id string, pos int, code string")
    lists = spark.createDataFrame([(f"c{i}", [(1, f"t{i}")]) for i in range(4)], "code string, pool array<struct<public_rank:int,text:string>>")

    def step(key, rows):
        return [(r.pos, r.pool[0]["text"] if r.pool else None) for r in rows]

    got = [tuple(r) for r in M.fold(events, ["session_id"], ["pos"], step, "session_id string, pos int, text string", lists).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(f"s{i % 7}", i, f"t{i % 5}" if i % 11 and i % 5 < 4 else None) for i in range(200)]
    assert all([p for s, p, _ in got if s == f"s{k}"] == list(range(k, 200, 7)) for k in range(7))
    plan = audits.adaptive_report(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "__parts" in plan and "Join LeftOuter" not in plan


def test_merged_probabilities():
    memory = A.Memory()
    for _ in range(2):
        memory.observe(0, "x", "新")
        memory.confirm()
    rows, share = A.merged(memory, "x", [("甲", 3.0), ("乙", 1.0)], A.Profile())
    assert share == pytest.approx(0.05 * 8 / 12) and sum(p for _, _, p in rows) == pytest.approx(1)
    assert [(t, s) for t, s, _ in rows] == [("甲", "public"), ("乙", "public"), ("新", "personal")]


def test_coalescer():
    paint = M.Coalescer(50)
    assert not paint.input(1, 1, 0) and paint.frame(2, 1) == "stale" and paint.frame(1, 5) == "deferred" and not paint.timer(49) and paint.timer(50) and paint.frame(1, 60) == "painted"
    assert not paint.input(2, 2, 70) and paint.frame(2, 75) == "paint" and not paint.force()
    paint.input(3, 3, 80)
    paint.frame(3, 85)
    assert paint.input(4, 4, 90) and not paint.force()
    paint.frame(4, 95)
    paint.cancel()
    assert paint.frame(4, 96) == "stale" and not paint.timer(999) and not paint.force()
    for sizes, delay in itertools.product(([1], [2], [3, 4], []), (16, 120)):
        assert sum(M.coalesced(sizes, 40, 5, delay)) == sum(sizes)


def test_key_buffer():
    buffer = M.KeyBuffer(3)
    assert [buffer.observe(k) for k in "abcdefg"] == [False, False, False, True, False, False, True]
    assert (buffer.keys, buffer.complete, buffer.resets) == (["g"], False, 2)


def selections(n, begin=0):
    rnd = random.Random(7)
    rows = [(b, "p", b % 3, f"{k:03}", rnd.choice("xy"), rnd.choice("甲乙丙")) for b in range(begin + n) for k in range(rnd.randint(1, 3))]
    return [r for r in rows if r[0] >= begin]


def test_snapshots(spark, tmp_path):
    named = lambda rows: snapshots.name_batches(spark.createDataFrame(rows, SELECTION), "created", "process", "sequence")
    every, old = named(selections(12)), named(selections(7))
    state = lambda memory: sorted(map(tuple, memory.state.collect()))
    want = sorted(map(tuple, snapshots.fold(every).collect()))
    first = snapshots.full(old)
    assert (snapshots.load(every, [first]).way, state(snapshots.load(every, [first]))) == ("checkpoint", want)
    assert snapshots.load(every, []).way == "full"
    late = snapshots.full(named(selections(5, 7)))
    assert (snapshots.load(every, [late]).way, state(snapshots.load(every, [late]))) == ("full", want)
    foreign = snapshots.full(named([(3, "q", 0, "000", "x", "无")]))
    assert snapshots.load(every, [foreign, first]).way == "checkpoint"
    assert snapshots.refresh(old, first, []).way == "same"
    assert (snapshots.refresh(every, first, []).way, state(snapshots.refresh(every, first, []))) == ("tail", want)
    assert snapshots.refresh(old, snapshots.full(every), [first]).way == "checkpoint"
    assert snapshots.refresh(every, late, []).way == "full"
    path = str(tmp_path / "batches")
    snapshots.save(old, path)
    snapshots.save(every, path)
    snapshots.save(every, path)
    assert sorted(map(tuple, spark.read.parquet(path).select(*every.columns).collect())) == sorted(map(tuple, every.select(*every.columns).collect()))
    assert not snapshots.due(every, first.names) and snapshots.due(named(selections(70)), spark.createDataFrame([], "name string"))
    kept = snapshots.recent(snapshots.fold(every), 2).collect()
    assert sorted(tuple(r["last"]) for r in kept) == sorted(w[3] for w in want)[-2:] if len({tuple(w[3]) for w in want}) == len(want) else len(kept) == 2


def test_swapped_sentences(spark, small, monkeypatch):
    rows = [(1, 1, "词", "ci", 50), (2, 1, "库", "ku", 30), (3, 1, "词库", "ci ku", 10)]
    words = lexicon.lexicon(spark.createDataFrame(rows, "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))
    codes = spark.createDataFrame([("icku",), ("ciku",), ("cikuic",), ("zz",)], "observed string")
    monkeypatch.setattr(audits.V, "words", lambda *a: words)
    monkeypatch.setattr(audits.V, "observed", lambda *a: codes)
    got = {(r.observed, r.text): r.place for r in audits.swap_recovery_sentences(spark, small).collect()}
    primary = {(r.observed, r.text) for r in lattice.sentences(lattice.noisy_edges(codes, words, 10), words, top=5, literals=True, codes=codes).collect()}
    assert not set(got) & primary
    for (observed, text), place in got.items():
        swapped = observed[: place - 1] + observed[place] + observed[place - 1] + observed[place + 1 :]
        assert any(r.text == text for r in lattice.sentences(lattice.noisy_edges(spark.createDataFrame([(swapped,)], "observed string"), words, None, corrections=False), words, top=20).collect())
    spans = {(r.observed, r.first, r.n_syllables, r.text) for r in audits.span_recovery(spark, small).collect()}
    assert spans == {("icku", 0, 1, "词库")}


def test_swaps_of_long_codes_are_recovered(spark, small, monkeypatch):
    """A swap at the end of a code of eighteen keys, whose first words as typed are others."""
    rows = [(f"近{k}", "la", 9000 - 7 * k) for k in range(12)] + [("换", "lu", 3)]
    words = lexicon.lexicon(spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))
    monkeypatch.setattr(audits.V, "words", lambda *a: words)
    monkeypatch.setattr(audits.V, "observed", lambda *a: spark.createDataFrame([("la" * n + "ul",) for n in (2, 8)] + [("l",)], "observed string"))
    got = audits.swap_recovery_sentences(spark, small).collect()
    for n in (2, 8):
        own = sorted((r["rank"], r.text, r.place) for r in got if r.observed == "la" * n + "ul")
        assert [rank for rank, *_ in own] == [1, 2, 3, 4, 5] and all(text.endswith("换") and place == 2 * n + 1 for _, text, place in own)
    assert {len(r.observed) for r in got} == {6, 18}


def test_best_segmentation_prefers_known_transitions(spark, small):
    rows = audits.best_segmentation(spark, small)
    assert rows.count() == rows.select("observed", "text").distinct().count() > 0
    assert rows.where(F.replace("segments", F.lit("|"), F.lit("")) != F.col("text")).count() == 0


def test_layered_and_profile_queries_have_rows(spark, small):
    """Rows that the definitions fix: composition ranks follow the layers; profile deltas are differences to the reference."""
    from glyphweir.plans import extras

    layered = extras.layered_query(spark, small).collect()
    per = {}
    for r in layered:
        per.setdefault(r.observed, []).append((r["rank"], r.text))
    assert layered and all([k for k, _ in sorted(own)] == list(range(1, len(own) + 1)) and len({t for _, t in own}) == len(own) for own in per.values())
    loop = {r.profile: r for r in extras.adaptive_closed_loop(spark, small).collect()}
    for r in extras.profile_delta(spark, small).collect():
        assert r.adapted_first_delta == loop[r.profile].adapted_first - loop["reference"].adapted_first and r.lost_delta == loop[r.profile].lost - loop["reference"].lost


def test_tracker_and_paint_folds(spark, small):
    from glyphweir.plans import extras, views

    tracked = extras.tracker_fold(spark, small).collect()
    assert tracked and all(r.n_found == r.n_changes for r in tracked)  # each change is found again as one span
    rows = sorted((r.session_id, r.segment_seq, r.pos, r.event_id, r.elapsed_ms) for r in views.events(spark, small, "session_id", "segment_seq", "pos", "elapsed_ms").collect())
    want = {}
    for delay in (500, 1000, 2000, 4000):
        shown = hidden = 0
        for _, own in itertools.groupby(rows, key=lambda r: r[:2]):
            times = [r[4] for r in own]
            for i, at in enumerate(times):
                late = i % 2 == 1 or i + 1 == len(times) or max(0, times[i + 1] - at) >= delay
                shown, hidden = shown + late, hidden + (not late)
        want[delay] = (shown, hidden)
    assert {r.delay: (r.shown, r.hidden) for r in extras.paint_timer_fold(spark, small).collect()} == want


def test_noisy_lattice_counts(spark, small):
    """The edges kept of every part are the best five of each kind of use, by brute force over the matches."""
    from glyphweir.plans import views

    words = views.words(spark, small)
    codes = spark.createDataFrame(views.observed(spark, small).orderBy("observed").limit(6).collect(), "observed string")
    kept = {(r.observed, r.low, r.high, r.text, r.code, r.kind) for r in lattice.noisy_edges(codes, words, 5).collect()}
    whole = {(r.observed, r.low, r.high, r.text, r.code, r.kind) for r in lattice.noisy_edges(codes, words, None).collect()}
    found = {(r.observed, r.text, r.code, r.kind) for r in noisy.matches(lattice.spans(codes, False).select(F.col("piece").alias("observed")).distinct(), words).collect()}
    assert kept <= whole and all((o[low:high], t, c, k) in found for o, low, high, t, c, k in whole)


def test_rolling_buffers_by_replay(spark, small):
    from glyphweir.plans import sessions

    rows = sorted((r.session_id, r.segment_seq, r.pos, r.event_id, len(r.inserted) + len(r.deleted) + len(r["keys"] or ()) + 16) for r in sessions._flat(spark, small).collect())
    want = {}
    for session, own in itertools.groupby(rows, key=lambda r: r[0]):
        held, dropped = [], 0
        for *_, size in own:
            while held and sum(held) + size > 4_096:
                gone = max(1, len(held) // 8)
                held, dropped = held[gone:], dropped + gone
            held = [*held, size] if size <= 4_096 else held
        want[session] = (len(held), sum(held), dropped)
    assert {r.session_id: (r.n_kept, r.size, r.n_dropped) for r in sessions.rolling_buffer(spark, small).collect()} == want


def test_recalls_and_lists_are_consistent(spark, small):
    from glyphweir.plans import corpus, extras

    recall, cases = audits.sentence_recall(spark, small).first(), extras.authored_cases(spark, small).count()
    assert recall.n == cases and 0 <= recall.top1 <= recall.top5 <= recall.top10 <= cases
    per = {}
    for r in corpus.interactive_query_whole(spark, small).collect():
        per.setdefault(r.observed, []).append((r["rank"], r.lane, r.text))
    for observed, own in per.items():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and len({t for _, _, t in own}) == len(own) <= 20
        assert [lane for _, lane, _ in own] == sorted(lane for _, lane, _ in own) and (own[0][1] < 5 or [t for _, _, t in own] == [observed])
