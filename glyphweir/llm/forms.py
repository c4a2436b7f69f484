"""One stored form for texts that look the same.

The distinct texts of each Arrow batch go through one DuckDB statement: characters without room are removed by a regular
expression, look-alikes, widths, blanks, Han radicals and other fonts are mapped by translate, ligatures by replace, and
composing marks and compatibility ideographs by nfc_normalize. Each step is taken only by texts that a regular expression
finds in need of it, and texts of printable ASCII, which are their own form, skip the statement. Letter case, raised and
circled digits stay apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphweir.session import cut

# Characters that are drawn with the shape of another one, each before the one it becomes.
LETTERS = """
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ҮY ӀI
аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv ӏl
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ
οo νv ϲc ϳj օo ՕO ɑa ⲁa ɡg ⲟo ꓳO
µμ ∆Δ ∑Σ ∏Π
ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ
ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ
ⲂB ⲤC ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲦT ⲨY ⲬX ⲣp ⲥc
ᴄc ᴏo ꜱs ᴜu ᴠv ᴡw ᴢz
"""
SIGNS = """
‐- ‑- −- ﹣- ⁃- ˗- ‒– ―— ∕/ ⁄/ ∗* ∼~ 〜~ ∶: ꞉: ‧· ・· ∙· ⋅· ⸱· ․. ‚, ǃ! ∣| ǀ| ˚° ʼ’
"""
RADICALS = """
⺁厂 ⺂乛 ⺃乚 ⺅亻 ⺆冂 ⺉刂 ⺊卜 ⺋㔾 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺞歺 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬
⺤爫 ⺥爫 ⺦丬 ⺨犭 ⺩王 ⺪疋 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺳㓁 ⺹耂 ⺺肀 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝
⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦
⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟
"""
#: Characters that take no room, besides format characters, as a class of regular expressions.
NO_ROOM = r"[\p{Cf}\x{0}-\x{8}\x{E}-\x{1F}\x{7F}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


#: Kinds of compatibility characters that are drawn with the shape of what they stand for: other fonts, widths and sizes.
ALIKE_TAGS = ("<font>", "<small>", "<wide>", "<narrow>")


def _blocks(*bounds: tuple[int, int]) -> Iterator[str]:
    for low, high in bounds:
        yield from map(chr, range(low, high + 1))


@cache
def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """By rule, one character to one and one to several: fonts, widths, sizes and Han radicals; ligatures, joined letters,
    Roman numerals and squared units."""
    single, joined = {}, {}
    for c in _blocks((0xA0, 0xD7FF), (0xF900, 0xFFEE), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF), (0x1FBF0, 0x1FBF9)):
        if unicodedata.decomposition(c).startswith(ALIKE_TAGS) or "\u2f00" <= c <= "\u2fd5":
            plain = unicodedata.normalize("NFKC", c)
            (single if len(plain) == 1 else joined)[c] = plain
    for c in _blocks((0xFB00, 0xFB06), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x3371, 0x33DF), (0x33FF, 0x33FF)):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c:
            (single if len(plain) == 1 else joined)[c] = plain
    return single, joined


@cache
def single_map() -> dict[str, str]:
    """One character to one: the fixed look-alikes, and by rule the compatible ones, blanks and letters with marks."""
    pairs = {p[0]: p[1:] for p in (LETTERS + SIGNS + RADICALS).split()}
    for c, plain in _compatible()[0].items():
        if plain != c:
            pairs[c] = pairs.get(plain, plain)
    for c in _blocks((0x9, 0x9), (0xB, 0xC), (0x85, 0x85), (0xA0, 0x3000), (0x3164, 0x3164)):
        if c in "\t\x0b\x0c\x85ㅤ" or unicodedata.category(c) == "Zs":
            pairs[c] = " "
    for c in _blocks((0x370, 0x52F), (0x1F00, 0x1FFF)):  # Greek and Cyrillic letters with marks
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in pairs:
            whole = unicodedata.normalize("NFC", pairs[base] + "".join(marks))
            if len(whole) == 1:
                pairs[c] = whole
    return pairs


@cache
def joined_map() -> dict[str, str]:
    """One character to several, in their own one form."""
    pairs = single_map()
    return {c: "".join(pairs.get(x, x) for x in plain) for c, plain in _compatible()[1].items()}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters: Iterable[str]) -> str:
    """A regular expression's class of these characters, as ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{low:X}}}" + (rf"-\x{{{high:X}}}" if high > low else "") for low, high in ranges) + "]"


@cache
def form_sql(column: str) -> str:
    """The expression, as DuckDB SQL, that gives the one form of a column."""
    pairs, joined = single_map(), joined_map()
    bare = f"(CASE WHEN regexp_matches({column}, '{NO_ROOM}') THEN regexp_replace({column}, '{NO_ROOM}', '', 'g') ELSE {column} END)"
    value = f"(CASE WHEN regexp_matches({column}, '{_class(pairs)}') THEN translate({bare}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))}) ELSE {bare} END)"
    whole = value
    for c, plain in joined.items():
        whole = f"replace({whole}, {_quoted(c)}, {_quoted(plain)})"
    return f"nfc_normalize(CASE WHEN regexp_matches({column}, '{_class(joined)}') THEN {whole} ELSE {value} END)"


def one_form(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each text column (key) its one form under the name given (value); columns of that name are replaced.

    Null stays null and empty stays empty. One narrow stage; each task holds one Arrow batch and one DuckDB connection.
    """
    kept = [c for c in df.columns if c not in columns.values()]
    prefix = "__text"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    source = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(columns)))
    statement = f"SELECT {form_sql('text')} AS form FROM batch"
    schema = T.StructType([*source.schema.fields[: len(kept)], *(T.StructField(c, T.StringType()) for c in columns.values())])

    def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1").fetchall()

        def formed(column: pa.Array) -> pa.Array:
            coded = column.cast(pa.string()).dictionary_encode()
            unclear = pc.match_substring_regex(coded.dictionary, r"[^\x20-\x7E]")
            if not pc.any(unclear).as_py():
                return column.cast(pa.string())
            con.register("batch", pa.table([coded.dictionary.filter(unclear)], names=["text"]))
            forms = con.sql(statement).to_arrow_table().column(0).combine_chunks().cast(pa.string())
            con.unregister("batch")
            return pc.replace_with_mask(coded.dictionary, unclear, forms).take(coded.indices)

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(formed(batch.column(len(kept) + i)) for i in range(len(columns)))], names=schema.names)

    return source.mapInArrow(unify, schema)


def alike_pairs(left: DataFrame, right: DataFrame | None, keys: list[str]) -> DataFrame:
    """Pairs (low_id, high_id) of rows that agree in ``keys`` and in the form of their texts but not in the texts.

    ``left`` and ``right`` have the keys, ``id`` and ``text``; without ``right`` the pairs are within ``left``. Null and
    empty texts and null keys have no pairs; repeated rows give a pair once.

    Every text is brought to its form once, and what that gives is cut. Each (keys, form) is reduced to the least and
    greatest hashes of its texts, in every task before the shuffle; only where they differ do rows go on. These are joined
    over their distinct texts, so that any number of equal texts costs no comparison with each other: the work follows the
    pairs in the result, not the squares of hot groups.
    """
    sides = [left.select(*keys, "id", "text", F.lit(0).alias("side"))]
    if right is not None:
        sides.append(right.select(*keys, "id", "text", F.lit(1).alias("side")))
    rows = sides[0] if right is None else sides[0].unionByName(sides[1])
    rows = rows.where((F.col("text") != "") & F.col("id").isNotNull())
    at = [*keys, "form"]
    made = cut(one_form(rows, {"text": "form"}).withColumn("form", F.when(F.col("form") != F.col("text"), F.col("form"))))
    formed = made.withColumn("form", F.coalesce("form", "text"))
    hashes = {"h": F.xxhash64("text"), "g": F.hash("text"), "s": F.col("side")}
    bounds = [f(x).alias(f"{name}_{n}") for n, x in hashes.items() for f, name in ((F.min, "least"), (F.max, "most"))]
    unequal = (F.col("least_h") != F.col("most_h")) | (F.col("least_g") != F.col("most_g"))
    mixed = formed.groupBy(*at).agg(*bounds).where(unequal & (F.col("least_s") != F.col("most_s") if right is not None else F.lit(True))).select(*at)
    some = cut(formed.join(mixed, at, "left_semi"))
    a = some.where("side = 0").select(*at, F.col("text").alias("text_a"), F.col("id").alias("a"))
    b = some.where(f"side = {int(right is not None)}").select(*at, F.col("text").alias("text_b"), F.col("id").alias("b"))
    unlike = F.col("text_a") < F.col("text_b") if right is None else F.col("text_a") != F.col("text_b")
    texts = a.drop("a").distinct().join(b.drop("b").distinct(), at).where(unlike)
    pairs = texts.join(a, [*at, "text_a"]).join(b, [*at, "text_b"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("low_id"), F.greatest("a", "b").alias("high_id")).distinct()
