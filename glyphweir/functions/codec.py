"""Double-pinyin codec as column expressions: a syllable becomes two keys, its initial and its final."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key layout.
ZERO_INITIAL = {"a": "aa", "o": "oo", "e": "ee", "ai": "ai", "ei": "ei", "ao": "ao", "ou": "ou", "an": "an", "en": "en", "ang": "ah", "eng": "eg", "ong": "os", "er": "er"}
INITIAL_KEYS = {"zh": "v", "ch": "i", "sh": "u"}
SINGLE_INITIALS = "bpmfdtnlgkhjqxrzcsyw"
FINAL_KEYS = {
    "q": "iu", "w": "ia ua", "r": "uan van", "t": "ue ve", "y": "ing uai", "o": "uo o", "p": "un vn", "s": "ong iong", "d": "iang uang",
    "f": "en", "g": "eng", "h": "ang", "m": "ian", "j": "an", "c": "iao", "k": "ao", "l": "ai", "z": "ei", "x": "ie", "v": "ui v", "b": "ou", "n": "in",
    "a": "a", "e": "e", "i": "i", "u": "u",
}
TONE_MARKS = {"a": "āáǎà", "e": "ēéěèê", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "v": "üǖǘǚǜ", "n": "ńňǹ", "m": "ḿ"}
MOST_SYLLABLES = 12


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def normal_syllable(syllable: Column) -> Column:
    """Lower case, v for the front rounded vowel; null unless letters a to z remain."""
    plain = F.replace(F.replace(F.lower(syllable), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v"))
    return F.when(plain.rlike(r"\A[a-z]+\z"), plain)


def encode_syllable(syllable: Column) -> Column:
    """The two keys of a syllable, null where there are none."""
    plain = normal_syllable(syllable)
    pattern = rf"\A(zh|ch|sh|[{SINGLE_INITIALS}])([a-z]+)\z"
    initial, final = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
    final = F.when(initial.isin("j", "q", "x", "y") & (final == "u"), F.lit("v")).otherwise(final)
    finals = {f: key for key, own in FINAL_KEYS.items() for f in own.split()}
    keys = F.concat(F.coalesce(F.try_element_at(_map(INITIAL_KEYS), initial), initial), F.try_element_at(_map(finals), final))
    return F.when(plain.rlike("^[aeo]"), F.try_element_at(_map(ZERO_INITIAL), plain)).when(initial != "", keys)


def syllable_codes(pinyin: Column) -> Column:
    """Codes of the syllables of a spelling; null if there is none or one can't be encoded."""
    parts = F.filter(F.split(F.trim(pinyin), r"\s+"), lambda s: s != "")
    codes = F.transform(parts, encode_syllable)
    return F.when((F.size(parts) > 0) & F.forall(codes, lambda c: c.isNotNull()), codes)


def full_code(pinyin: Column) -> Column:
    return F.array_join(syllable_codes(pinyin), "")


def pairs_of(code: Column) -> Column:
    """The two-key codes of a full code."""
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))


def strip_tones(pinyin: Column) -> Column:
    """Letters without tone marks, v for the front rounded vowel; null where another character remains."""
    source = "".join(TONE_MARKS.values())
    target = "".join(letter * len(marks) for letter, marks in TONE_MARKS.items())
    plain = F.translate(F.regexp_replace(F.trim(pinyin), r"\s+", " "), source, target)
    return F.when(plain.rlike(r"\A[a-z:]+( [a-z:]+)*\z"), plain)


def anchored_tail(codes: Column) -> Column:
    """The first syllable in full, of each other its first key."""
    return F.concat(codes[0], F.array_join(F.transform(F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda c: F.left(c, F.lit(1))), ""))


def conservative_tail(codes: Column) -> Column:
    """All in full but the last, of which the first key; one syllable stays as it is."""
    n = F.size(codes)
    short = F.concat(F.array_join(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.left(F.element_at(codes, -1), F.lit(1)))
    return F.when(n > 1, short).otherwise(codes[0])


def all_short(codes: Column) -> Column:
    """Of each syllable its first key."""
    return F.array_join(F.transform(codes, lambda c: F.left(c, F.lit(1))), "")


def spellings(codes: Column) -> Column:
    """All spellings of a word as (spelling, abbreviated): each syllable in full or by its first key, 2^n of them."""
    start = F.array(F.struct(F.lit("").alias("spelling"), F.lit(0).alias("abbreviated")))

    def extend(done: Column, code: Column) -> Column:
        full = F.transform(done, lambda d: F.struct(F.concat(d["spelling"], code).alias("spelling"), d["abbreviated"].alias("abbreviated")))
        short = F.transform(done, lambda d: F.struct(F.concat(d["spelling"], F.left(code, F.lit(1))).alias("spelling"), (d["abbreviated"] + 1).alias("abbreviated")))
        return F.concat(full, short)

    return F.aggregate(codes, start, extend)


def alias_codes(code: Column) -> Column:
    """A full code and those that name the same sounds: u after j, q, x or y may stand for v. At most 2^n of them."""
    start = F.array(F.lit(""))

    def extend(done: Column, pair: Column) -> Column:
        plain = F.transform(done, lambda d: F.concat(d, pair))
        other = F.transform(done, lambda d: F.concat(d, F.left(pair, F.lit(1)), F.lit("v")))
        return F.when(pair.rlike("^[jqxy]u$"), F.concat(plain, other)).otherwise(plain)

    return F.aggregate(pairs_of(code), start, extend)
