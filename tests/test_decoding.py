import itertools
import math
import random

import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F

from glyphweir.functions import codec, keys
from glyphweir.operators import language, lattice, lexicon, noisy, readings, sampling, sieve
from glyphweir.plans import corpus, decoding

WORDS = [("词", "ci", 50), ("次", "ci", 20), ("词库", "ci ku", 30), ("库存", "ku cun", 12), ("存", "cun", 9), ("输入", "shu ru", 40), ("去", "qu", 7), ("绿", "lv", 3), ("词", "ci", 45)]


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, 1, t, p, f) for i, (t, p, f) in enumerate(WORDS)] + [(0, 2, "词", "ci", 60), (90, 1, None, "ci", 5), (91, 1, "坏", "xx", 5), (92, 1, "零", "ling", 0)]
    return lexicon.lexicon(spark.createDataFrame(rows, "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))


def test_codec(spark):
    cases = {"zhuang": "vd", "shi": "ui", "an": "an", "ang": "ah", "er": "er", "a": "aa", "ju": "jv", "lü": "lv", "nu:e": "nt", "QUAN": "qr", "yue": "yt", "xiong": "xs", "ng": None, "": None, "b": None, "zhx": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", codec.encode_syllable(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in got} == cases
    tones = {"nǚ ér": "nv er", "ńg": "ng", "hǎo  ma": "hao ma", "ça": None, "": None}
    got = spark.createDataFrame([(k,) for k in tones], "s string").select("s", codec.strip_tones(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in got} == tones


def test_short_codes(spark):
    row = spark.createDataFrame([(["ab", "cd", "ef"], ["gh"])], "c array<string>, one array<string>").select(*(f(F.col(x)).alias(f"{f.__name__}_{x}") for f in (codec.anchored_tail, codec.conservative_tail, codec.all_short) for x in ("c", "one"))).first()
    assert tuple(row) == ("abce", "gh", "abcde", "gh", "ace", "g")


def test_neighbours_are_symmetric():
    assert {p[::-1] for p in keys.PAIRS} == set(keys.PAIRS)


def one_edit(a: str, b: str) -> str | None:
    if a == b:
        return "exact"
    if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
        return "missing"
    if len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
        return "extra"
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        if len(d) == 1 and b[d[0]] + a[d[0]] in keys.PAIRS:
            return "neighbour"
        if len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]:
            return "swap"
    return None


def test_classifier_and_matches_against_brute_force(spark, words):
    rnd = random.Random(5)
    codes = sorted({"".join(rnd.choice("cikuvnurqlas") for _ in range(rnd.randint(1, 5))) for _ in range(150)} | {"ci", "cikv", "ciku", "kicu", "cku", "ciiku"})
    table = [(r.spelling, r.text, r.code) for r in lexicon.spelling_table(words).collect()]
    got = {(r.observed, r.spelling, r.text, r.code): r.kind for r in noisy.matches(spark.createDataFrame([(c,) for c in codes], "observed string"), words).collect()}
    want = {(c, s, t, code): k for c in codes for s, t, code in table if (k := one_edit(c, s))}
    assert got == want
    pairs = spark.createDataFrame([(c, s) for c in codes for s in {s for s, _, _ in table}], "a string, b string")
    kinds = {(r.a, r.b): r.k for r in pairs.select("a", "b", noisy.classify(F.col("a"), F.col("b"))["kind"].alias("k")).collect()}
    assert kinds == {(c, s): one_edit(c, s) for c, s in kinds}


def test_decode_order_and_empty(spark, words):
    codes = spark.createDataFrame([("ci",), ("ci",), (None,), ("",), ("zzzz",)], "observed string")
    rows = noisy.decode(codes, words, 3).orderBy("observed", "rank").collect()
    assert [(r.observed, r.text) for r in rows][:2] == [("ci", "词"), ("ci", "次")] and rows[0].frequency == 60
    assert noisy.decode(codes.limit(0), words).count() == 0
    assert {r.text for r in noisy.decode_exact(spark.createDataFrame([("qu",)], "observed string"), words).collect()} == {"去"}


def enumerate_paths(observed, edges, total, literals=True):
    out = []

    def walk(at, used, score, texts, codes, unresolved):
        if at == len(observed):
            out.append((unresolved, used, -round(score, 9), len(texts), "".join(texts)))
            return
        for e in edges:
            if e["low"] == at and not (used and e["kind"] != "exact"):
                own = math.log(e["frequency"] / total) - lattice.ABBREVIATION_COST * e["abbreviated"] - lattice.CORRECTION_COST[e["kind"]]
                walk(e["high"], used or e["kind"] != "exact", score + own, [*texts, e["text"]], codes, unresolved)
        if literals:
            walk(at + 1, used, score - lattice.LITERAL_COST, [*texts, f"〔{observed[at]}〕"], codes, unresolved + 1)

    walk(0, False, 0.0, [], [], 0)
    return sorted(out)


def test_best_path_against_enumeration():
    rnd = random.Random(3)
    for _ in range(60):
        observed = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
        edges = []
        for low, high in itertools.combinations(range(len(observed) + 1), 2):
            for k in range(rnd.randint(0, 2)):
                edges.append({"low": low, "high": high, "text": f"w{low}{high}{k}", "code": f"c{low}{high}{k}", "frequency": rnd.randint(1, 50), "abbreviated": rnd.randint(0, 1), "kind": rnd.choice(["exact", "exact", "swap", "extra"]), "spelling": "x"})
        want = enumerate_paths(observed, edges, 100)
        got = lattice.best_paths(observed, edges, 100, keep=50)
        assert got[0].order()[:5] == want[0]
        clean = [w for w in want if not w[1]][:5]
        assert [p.order()[:5] for p in got if not p.used_error][: len(clean)] == clean


def test_literal_path_of_unknown_code(spark, words):
    codes = spark.createDataFrame([("zzz",), ("ci",)], "observed string")
    rows = {r.observed: r for r in lattice.sentences(lattice.exact_edges(codes, words), words, top=1, literals=True, codes=codes).collect()}
    assert rows["zzz"].text == "〔z〕〔z〕〔z〕" and rows["zzz"].unresolved == 3 and rows["zzz"].score == -24.0
    assert rows["ci"].text == "词" and rows["ci"].segments == ["词"]


def test_greedy_first_unseen(spark):
    rnd = random.Random(8)
    rows = [(g, p, rnd.choice("abcdefgh")) for g in range(12) for p in range(rnd.randint(0, 4))]
    want, taken = {}, set()
    for g in range(12):
        for p, t in sorted((p, t) for h, p, t in rows if h == g):
            if t not in taken:
                taken.add(t)
                want[g] = (p, t)
                break
    got = sampling.greedy_first_unseen(spark.createDataFrame(rows, "g int, p int, t string"), "g", "p", "t").collect()
    assert {r.g: (r.p, r.t) for r in got} == want


def test_spread(spark):
    got = sorted(r.id for r in sampling.spread(spark.range(10), 4, "id").collect())
    assert got == [(i * 10 + 5) // 4 for i in range(4)]
    assert sampling.spread(spark.range(2), 4, "id").count() == 2 and sampling.spread(spark.range(0), 4, "id").count() == 0


def test_effective_code_and_span(spark):
    cases = {("a", "b", "SP"): ("ab", None), ("a", "b", "BS", "c"): ("ac", None), ("a", "b", "LEFT", "x"): ("axb", None), ("a", "b", "HOME", "DEL"): ("b", None), ("a", "SP", "b"): (None, "after_selection"), ("a", "ESC"): (None, "cancelled"), ("S+a",): (None, "shifted"), ("?",): (None, "unknown_key"), (): ("", None), ("BS",): ("", None), ("a", "END", "3"): ("a", None)}
    got = spark.createDataFrame([(list(k),) for k in cases], "k array<string>").select("k", keys.effective_code(F.col("k")).alias("e")).collect()
    assert {tuple(r.k): (r.e.code, r.e.fault) for r in got} == cases
    spans = {("abc", "axc"): (1, "b", "x", False), ("aa", "aaa"): (2, "", "a", True), ("", "x"): (0, "", "x", False), ("x", ""): (0, "x", "", False)}
    got = spark.createDataFrame([*spans, ("a", "a")], "a string, b string").select("a", "b", keys.single_span(F.col("a"), F.col("b")).alias("d")).collect()
    assert {(r.a, r.b): tuple(r.d) for r in got if r.d} == spans


def test_fingerprint(spark):
    assert keys.fnv1a64(b"") == 0xCBF29CE484222325 and keys.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert spark.createDataFrame([("a",), (None,)], "t string").select(keys.fingerprint(F.col("t")).alias("f")).collect()[0].f == "af63dc4c8601ec8c"


def test_recovered_swaps_survive_crowded_spans(spark):
    """Lanes of trimmed edges equal those of untrimmed ones where over 20 frequent words crowd a recovered swap out of its span."""
    rows = [(f"近{p}{k}", p, 9000 - 7 * k) for p in ("la", "sha", "li") for k in range(12)] + [(f"常{k}", "la sha", 500 + k) for k in range(25)]
    rows += [(f"换{i}", p, 3 + i) for i, p in enumerate(["lu", "lu sha", "lu la", "ku", "shu la"])] + [("缀", "la", 4), ("缀", "lu la", 2), ("长", "lu sha la", 5)]
    words = lexicon.lexicon(spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))
    codes = spark.createDataFrame([(c,) for c in ("ul", "ulu", "ull", "uk", "ulla", "laul", "uull", "ulul", "lual", "uluul")], "observed string")
    whole, trimmed = ({tuple(r) for r in lattice.lanes(lattice.noisy_edges(codes, words, keep), words).collect()} for keep in (None, 20))
    assert trimmed == whole
    assert ("ul", "recovery", 1, "换0") in {r[:4] for r in trimmed}


def test_readings_of_any_number_of_words(spark, words):
    codes = spark.createDataFrame([("ci",), ("cikucp",), ("cicici",), ("cik",), ("cicik",)], "observed string")
    full = {(r.observed, r.text) for r in corpus._readings(codes, words, 5).collect()}
    assert {("ci", "词"), ("ci", "次"), ("cikucp", "词库存"), ("cicici", "词词词")} <= full and "cik" not in {o for o, _ in full}
    short = {(r.observed, r.text) for r in corpus._readings(codes, words, 5, shortcuts=True).collect()}
    assert full <= short and {("cik", "词库"), ("cicik", "词词库")} <= short
    fixed = corpus._fixed_readings(spark.createDataFrame([("a", ["ci", "kucp"]), ("b", ["ci", "zz"])], "id string, codes array<string>"), words, 5).orderBy("rank").collect()
    assert [(r.id, r.text) for r in fixed] == [("a", "词库存"), ("a", "次库存")]


def test_modes_read_together_are_those_read_apart(spark, words):
    codes = spark.createDataFrame([(c,) for c in ("ci", "cikucp", "cicici", "cik", "cicik", "c", "kucpc", "zz", "zzcik", "ci" * 14 + "k")], "observed string")
    got = {tuple(r) for r in lattice.full_and_shortcut(codes, words, 2).collect()}
    apart = {(mode, r.observed, r["rank"], r.text, r.score) for mode, short in (("full", False), ("shortcut", True)) for r in corpus._readings(codes, words, 2, shortcuts=short).collect()}
    assert got == apart and ("shortcut", "cik", "词库") in {(r[0], r[1], r[3]) for r in got}


def test_second_reading_of_a_text(spark):
    rows = [(1, 1, "行", "hang", 9), (2, 1, "行", "xing", 5), (3, 1, "人", "ren", 4)]
    words = lexicon.lexicon(spark.createDataFrame(rows, "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))
    got = corpus._readings(spark.createDataFrame([("xyrf",), ("hhrf",)], "observed string"), words, 5).collect()
    assert {(r.observed, r.text) for r in got} == {("xyrf", "行人"), ("hhrf", "行人")}


def test_compositions_with_several_core_words(spark):
    own, added = [("词", "ci", 50), ("次", "ci", 20), ("库", "ku", 30), ("去", "qu", 7)], [("新词", "shu ru", 5)]
    core, more = (lexicon.lexicon(spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "entry_id bigint, revision int, text string, pinyin string, frequency bigint")) for rows in (own, added))
    codes = spark.createDataFrame([("cikuuuru",), ("uuruci",), ("uuru",)], "observed string")
    got = {(r.observed, r.rank): r.text for r in corpus._compositions(codes, core, more).collect()}
    assert got == {("cikuuuru", 1): "词库新词", ("cikuuuru", 2): "次库新词", ("uuruci", 1): "新词词", ("uuruci", 2): "新词次"}


def test_trajectories_of_long_words(spark):
    rows = [(1, 1, "词", "ci", 5), (2, 1, "词库存输入去绿", "ci ku cun shu ru qu lv", 4)]
    words = lexicon.lexicon(spark.createDataFrame(rows, "entry_id bigint, revision int, text string, pinyin string, frequency bigint"))
    assert {r.syllable: r.n for r in decoding._trajectories(words).collect()} == {1: 2} | dict.fromkeys(range(2, 8), 1)


def test_trajectory_query_has_long_words(spark, small):
    assert decoding.prefix_trajectory(spark, small).agg(F.max("syllable")).first()[0] > 6


def test_best_path_with_transitions_against_enumeration():
    rnd = random.Random(5)
    for _ in range(60):
        observed = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5)))
        edges = []
        for low, high in itertools.combinations(range(len(observed) + 1), 2):
            for k in range(rnd.randint(0, 2)):
                edges.append({"low": low, "high": high, "text": f"w{high - low}{k}", "code": f"c{low}{high}{k}", "frequency": rnd.randint(1, 50), "abbreviated": 0, "kind": rnd.choice(["exact", "exact", "swap"]), "spelling": "x"})
        texts = sorted({e["text"] for e in edges})
        pairs = {(a, b): rnd.randint(1, 9) for a in texts for b in texts if rnd.random() < 0.5}
        totals = {a: sum(n for (x, _), n in pairs.items() if x == a) for a in texts}
        model = lattice.Model(pairs, totals, len(texts) + 1)
        found = []

        def walk(at, used, score, before, said, unresolved):
            if at == len(observed):
                found.append((unresolved, used, -round(score, 9), len(said), "".join(said)))
                return
            for e in edges:
                if e["low"] == at and not (used and e["kind"] != "exact"):
                    own = math.log(e["frequency"] / 100)
                    if before:
                        own = lattice.UNIGRAM_SHARE * own + lattice.BIGRAM_SHARE * model.log(before, e["text"])
                    walk(e["high"], used or e["kind"] != "exact", score + own - lattice.CORRECTION_COST[e["kind"]], e["text"], [*said, e["text"]], unresolved)
            walk(at + 1, used, score - lattice.LITERAL_COST, "", [*said, f"〔{observed[at]}〕"], unresolved + 1)

        walk(0, False, 0.0, "", [], 0)
        assert lattice.best_paths(observed, edges, 100, keep=50, model=model)[0].order()[:5] == min(found)


@pytest.mark.parametrize("literals", [False, True])
@pytest.mark.parametrize("with_model", [False, True])
def test_one_lane_paths_are_the_best_paths(literals, with_model):
    rnd = random.Random(6)
    for _ in range(80):
        observed = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7)))
        edges = [{"low": a, "high": b, "text": rnd.choice("xyz") * (b - a), "code": f"{a}{b}{k}", "frequency": rnd.randint(1, 9)} for a, b in itertools.combinations(range(len(observed) + 1), 2) for k in range(rnd.randint(0, 2))]
        texts = sorted({e["text"] for e in edges})
        pairs = {(a, b): rnd.randint(1, 9) for a in texts for b in texts if rnd.random() < 0.4}
        model = lattice.Model(pairs, {a: sum(n for (x, _), n in pairs.items() if x == a) for a in texts}, 9) if with_model else None
        want = [(p.unresolved, p.cost, p.n_words, p.text, p.texts) for p in lattice.best_paths(observed, edges, 50, 5, literals=literals, model=model)[:5]]
        assert [(p.unresolved, p.cost, p.n_words, p.text, p.texts) for p in lattice.one_lane_paths(observed, edges, 50, 5, literals, model)] == want


def test_transitions_joined_or_handed_out(spark, words):
    """Beyond the bound of a model its table is joined, with the same sentences; a code of any length is read."""
    codes = spark.createDataFrame([("cikucp",), ("uurucp",), ("cicik",), ("zz",), ("ciku" * 20,)], "observed string")
    pairs = spark.createDataFrame([("词", "库存", 9), ("次", "库存", 40), ("输入", "存", 2), ("词库", "存", 1), ("词库", "词库", 5)], "prev string, cur string, n bigint")
    for edges in (lattice.exact_edges(codes, words), lattice.noisy_edges(codes.where("length(observed) < 9"), words, 5)):
        handed, joined = (sorted(tuple(r) for r in lattice.sentences(edges, words, top=3, literals=True, codes=codes, **how).collect()) for how in ({"model": language.model(pairs, 8)}, {"transitions": pairs, "size": 8}))
        assert handed == joined and len({r[0] for r in handed}) == 5


def test_a_model_holds_each_word_once(spark):
    model = language.model(spark.createDataFrame([("ab", "cd", 1), ("cd", "ab", 2), ("ab", "ef", 3)], "prev string, cur string, n bigint"), 3)
    words = [w for pair in model.pairs for w in pair]
    assert model.totals == {"ab": 4, "cd": 2} and model.pairs[("cd", "ab")] == 2 and len({id(w) for w in words}) == 3


def test_a_model_beyond_its_bound_is_no_model(spark, monkeypatch):
    monkeypatch.setattr(language, "PAIR_BOUND", 1)
    assert language.model(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "prev string, cur string, n bigint"), 2) is None


def test_two_words_keep_few_of_a_cut(spark):
    """The best texts of two words against all pairs, with ties, words of several lengths and texts that two pairs or cuts have."""
    rnd = random.Random(11)
    texts = {code: ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) + code[0] * rnd.randint(0, 1) for _ in range(14)] for code in ("aa", "bb", "aabb", "bbaa")}
    entries = {t: (code, rnd.choice((1, 2, 2, 7, 9, 10**12, 10**12 + 1))) for code, own in texts.items() for t in own}
    words = spark.createDataFrame([(t, code, "", f) for t, (code, f) in entries.items()], "text string, code string, pinyin string, frequency bigint")
    codes = ["aabb", "bbaa", "aabbaa", "bbaabb", "aabbaabb", "aab", "aa"]
    for keep in (1, 3, 5, 20):
        want = []
        for code in codes:
            found = {}
            for at in range(2, len(code) - 1, 2) if len(code) % 2 == 0 else ():
                for a, (c1, f1) in entries.items():
                    for b, (c2, f2) in entries.items():
                        if c1 + c2 == code and len(c1) == at:
                            own = (-round(math.log(f1) + math.log(f2), 9), at)
                            found[a + b] = min(found.get(a + b, own), own)
            want += [(code, rank, text, cost, at) for rank, (cost, text, at) in enumerate(sorted((c, t, at) for t, (c, at) in found.items())[:keep], 1)]
        df = corpus._best_two_words(spark.createDataFrame([(c,) for c in codes], "observed string"), words, keep)
        assert sorted((r.observed, r["rank"], r.text, -r.score, r["at"]) for r in df.collect()) == sorted(want)


def test_pairs_of_two_words_stay_in_a_row(spark):
    """Of a cut with 60 by 60 pairs only the five best are shuffled."""
    rows = [(f"{c}{i:03}", code, "", i + 1) for c, code in (("甲", "aa"), ("乙", "bb")) for i in range(60)]
    words = spark.createDataFrame(rows, "text string, code string, pinyin string, frequency bigint")
    df = corpus._best_two_words(spark.createDataFrame([("aabb",)], "observed string"), words, 5)
    assert df.count() == 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and "slice(pairs" in plan


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_places_of_texts_against_all_pairs(spark, monkeypatch, block):
    """Places of committed texts in both orders against all pairs ranked, with ties, transitions and texts that several pairs or cuts have."""
    monkeypatch.setattr(readings, "BLOCK", block)
    rnd = random.Random(7)
    pool = sorted({"".join(rnd.choice("abx") for _ in range(rnd.randint(1, 3))) for _ in range(60)} - {"x", "xx", "xxx"})
    entries = {t: ("".join(c + c for c in t if c != "x"), rnd.choice((1, 2, 2, 4, 7, 9))) for t in pool}  # x has no key
    steps = {(rnd.choice(pool), rnd.choice(pool)): rnd.choice((1, 1, 3, 40)) for _ in range(250)}
    codes = ["aabb", "bbaa", "aabbaa", "bbaabb", "aabbaabb", "aaaa", "aaaaaa", "aab", "aa"]
    placed, twice = {}, 0
    for code in codes:
        found: dict[str, list[tuple]] = {}
        for (a, (c1, f1)), (b, (c2, f2)) in itertools.product(entries.items(), repeat=2):
            if c1 + c2 == code:
                score = round(math.log(f1) + math.log(f2), 9)
                found.setdefault(a + b, []).append((-round(score + math.log1p(steps.get((a, b), 0)), 9), -score, len(c1)))
        twice += sum(len(own) > 1 for own in found.values())
        once = {t: min(own) for t, own in found.items()}
        for k, order in enumerate((lambda t: (once[t][1], t), lambda t: (once[t][0], t))):
            for place, text in enumerate(sorted(once, key=order), 1):
                placed.setdefault((code, text), [0, 0])[k] = place
    assert twice > 10
    held = readings.Lists((code, [t for t, own in entries.items() if own[0] == code], [math.log(f) for c, f in entries.values() if c == code]) for code in {c for c, _ in entries.values()})
    for code in codes:
        own = [t for c, t in placed if c == code]
        known = {(a, b): n for (a, b), n in steps.items() if entries[a][0] + entries[b][0] == code}
        assert sorted(readings.places(held, code, [*own, "no such text"], known)) == sorted((t, *placed[code, t]) for t in own)
    words = spark.createDataFrame([(t, code, "", f) for t, (code, f) in entries.items()], "text string, code string, pinyin string, frequency bigint")
    wanted = [*placed, ("aabb", "no such text"), ("aabb", None), ("aab", "a")]
    got = corpus._text_places(spark.createDataFrame(wanted, "observed string, text string"), words, spark.createDataFrame([(*k, n) for k, n in steps.items()], "first string, second string, n bigint"), 5).first()
    both = list(placed.values())
    assert tuple(got) == (len(both), sum(p == 1 for p, _ in both), sum(a == 1 for _, a in both), sum(a < p for p, a in both), sum(a > p for p, a in both))
    none = corpus._text_places(spark.createDataFrame([("aab", "a")], "observed string, text string"), words, spark.createDataFrame([], "first string, second string, n bigint"), 5).first()
    assert tuple(none) == (0,) * 5


def test_readings_of_two_words_are_ranked_in_their_task(spark, small):
    """No row is made for a pair of words: ranks come from counts, not from a window over all texts of a code."""
    plan = entry.queries()["protocol_context"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "windowspecdefinition(observed" not in plan


def test_variants_need_few_words_of_a_code(spark):
    """The nine best cuts without the words that nine others precede are those of all words; ties and several lengths too."""
    rnd = random.Random(3)
    own = {("".join(rnd.choice("甲乙") for _ in range(rnd.randint(1, 5))), code): rnd.choice((1, 2, 2, 5)) for code in ("aa", "bb", "aabb") for _ in range(60)}
    rows = [(t, c, "", f) for (t, c), f in own.items()]
    words = spark.createDataFrame(rows, "text string, code string, pinyin string, frequency bigint")
    codes = spark.createDataFrame([(c,) for c in ("aa", "aabb", "aabbaa", "bbaabb")], "observed string")
    few = corpus._ahead(words, 9)
    assert few.count() < words.count()
    got, want = ({tuple(map(str, r)) for r in lattice.sentences(lattice.exact_edges(codes, w), words, top=9, per_text=3).collect()} for w in (few, words))
    assert got == want and len(want) == 36


def test_a_filter_loses_nothing_and_stops_most(spark):
    texts = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("t"))
    own = sieve.filter_of(texts.where("t like '%7%'"), texts)
    passed = {r.t for r in texts.where(sieve.passes(own, F.col("t"))).collect()}
    inside = {r.t for r in texts.where("t like '%7%'").collect()}
    assert inside <= passed and len(passed) < len(inside) + 100
    nothing = sieve.filter_of(texts.limit(0), texts)
    assert texts.where(sieve.passes(nothing, F.col("t"))).count() == 0


def test_only_rows_that_may_find_a_partner_are_shuffled(spark, words):
    """Of a code's hypotheses and of the spellings without a key those stay that the other side's filter stops."""
    codes = spark.createDataFrame([("zpzpzp",), ("ci",)], "observed string")
    plan = noisy.matches(codes, words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shiftrightunsigned(scalar-subquery") >= 2


def test_a_code_given_twice_matches_once(spark, words):
    once, twice = (spark.createDataFrame([("ci",)] * n, "observed string") for n in (1, 2))
    assert sorted(map(tuple, noisy.matches(once, words).collect())) == sorted(map(tuple, noisy.matches(twice, words).collect()))


def test_codes_and_words_are_made_once(spark, words):
    """What the joins and filters of a decoding read several times is not made again for each."""
    codes = spark.range(7).select(F.lit("ci").alias("observed"))
    assert "Range (0, 7," not in noisy.decode(codes, words)._jdf.queryExecution().optimizedPlan().toString()
