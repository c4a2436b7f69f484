"""Byte-level BPE with a public vocabulary: the exact merges, in time linear in the text.

The bytes of a piece are mapped to Latin-1, so that one pyahocorasick automaton finds all tokens at all places. From left
to right the longest token is taken that may stand beside the one before; where none may, the last one gives way to the
next shorter. Whether two tokens may stand side by side is memoised: they may if no merge across their border comes before
the merges that made them. A place that was given up once is never tried again, for the encoding of a prefix is unique.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public byte-level vocabulary, and a proven bound of its size for the broadcast.
VOCABULARY = "byte_bpe_50k.json"
VOCABULARY_BYTES = 64_000_000
#: Pieces up to this many bytes are remembered, and so many of them, in each worker.
PIECE_BYTES, PIECES = 64, 300_000
#: Pairs of tokens of which a worker remembers whether they may stand side by side.
PAIRS = 2_000_000
_NEVER = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, str]:
    """The letters by which the vocabulary file writes bytes, each with the byte's Latin-1 character: printable ones
    stand for themselves, the others for the letters from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts by one vocabulary (the bytes of its file) and the pattern that cuts texts into pieces."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
        self.ids = {"".join(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        self.pieces = regex.compile(pattern).findall
        self.ranks: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            left, right = ("".join(letters[c] for c in part) for part in pair)
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.ranks[a << 32 | b] = rank
            self.parts.setdefault(whole, (a, b))
        self.automaton = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.beside: dict[int, bool] = {}
        self.spines: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.known: dict[str, list[int]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at one side (0: left) while ``token`` was made, each with the rank of the merge that ended it."""
        if (found := self.spines[side].get(token)) is None:
            found, at = [(token, _NEVER)], token
            while at in self.parts:
                rank = self.ranks[self.parts[at][0] << 32 | self.parts[at][1]]
                at = self.parts[at][side]
                found.append((at, rank))
            self.spines[side][token] = found
        return found

    def may_stand_beside(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again."""
        pair = left << 32 | right
        if (known := self.beside.get(pair)) is None:
            # At equal ranks the leftmost merge comes first: the left token's own before, the right one's own after.
            known = not any(
                (rank := self.ranks.get(a << 32 | b)) is not None and rank < until_a and rank <= until_b
                for a, until_a in self.spine(left, 1)
                for b, until_b in self.spine(right, 0)
            )
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            self.beside[pair] = known
        return known

    def piece(self, word: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        size = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(word):
            at[end + 1 - found[0]].append(found)  # ends come in order: shorter tokens first
        given_up = bytearray(size + 1)
        ids: list[int] = []
        choice: list[int] = []
        starts: list[int] = []
        place, k = 0, len(at[0]) - 1
        beside, may = self.beside, self.may_stand_beside
        while place < size:
            options, before = at[place], ids[-1] if ids else -1
            while k >= 0:
                length, token = options[k]
                if not given_up[place + length] and (before < 0 or (ok if (ok := beside.get(before << 32 | token)) is not None else may(before, token))):
                    break
                k -= 1
            if k >= 0:
                ids.append(token)
                choice.append(k)
                starts.append(place)
                place += length
                k = len(at[place]) - 1 if place < size else 0
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                given_up[place] = 1
                ids.pop()
                place, k = starts.pop(), choice.pop() - 1
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            if (found := known.get(piece)) is None:
                word = piece.encode().decode("latin-1")
                found = [self.ids[word]] if len(word) == 1 else self.piece(word)
                if len(word) <= PIECE_BYTES:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


@cache
def _cached(digest: str) -> list[Encoder]:
    return []


def worker_encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """The encoder of this Python worker, made once and kept across tasks."""
    kept = _cached(hashlib.sha256(vocabulary + pattern.encode()).hexdigest())
    if not kept:
        kept.append(Encoder(vocabulary, pattern))
    return kept[0]


def _read(path: str | None) -> bytes:
    data = Path(path or vocabulary_path()).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(data)} bytes is too large to broadcast")
    return data


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, lengths: bool = False) -> DataFrame:
    """(key, ids): the token ids of each text without special tokens; a null or empty text gives an empty list.

    With ``lengths`` (key, n_tokens) instead. Strings of special tokens are ordinary text. ``path`` names the vocabulary's
    file. One row per row of the input, repeats included; null keys are kept. One narrow stage: only key and text are
    read, and the vocabulary (its size is checked) is broadcast.
    """
    shared, pattern = documents.sparkSession.sparkContext.broadcast(_read(path)), split_pattern()
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                ids = [encoder.encode(t) if t else [] for t in some.column(1).to_pylist()]
                made = pa.array([len(i) for i in ids], pa.int32()) if lengths else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), made], names=[key, "n_tokens" if lengths else "ids"])

    schema = f"`{key}` {kind}, " + ("n_tokens int" if lengths else "ids array<int>")
    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(encode, schema)
