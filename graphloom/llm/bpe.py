"""BPE encoding and decoding with a contiguous rank array.

The vocabulary file is that of a public tokenizer (JSON, byte-level BPE with a word-end
suffix); its path is a parameter. Texts are cut into units by their bytes, many texts at
once: a unit is a run of letters, a digit or a run of other characters where that is plain
to see, else all that stands between white space. No pre-token reaches beyond its unit.
The ids of units are remembered up to a bound, and found by their 64-bit hashes.

encode() normalises and cuts a unit into pre-tokens (by the library's own normaliser and
pre-tokenizer unless it is ASCII) and encodes these by holding a pre-token's parts and the merge
ranks of adjacent parts in two short arrays: scan for the smallest rank, merge there
(delete a boundary), refresh the two neighbouring ranks, until no pair has a rank.
library_encode() lets the tokenizers library encode each unit.

Defined results: a null or blank text gives no ids; a pre-token of any length is encoded
whole (long ones with a heap over the same ranks, which gives the same merges); ids are
unsigned 32-bit little-endian integers in a BINARY column.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.llm.common import BLANK, LOWER, TEXT_BYTES, HashTable, binary_of, by_bytes, bytes_of, cache, hash_words, raw

#: Parts beyond which scanning for the minimum gives way to a heap.
SHORT = 256
#: Units remembered per worker.
REMEMBERED = 700_000
NONE = 1 << 60
#: Split patterns under which units are pre-tokens or hold them: letters, single numbers, other characters.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
SPACE, LETTER, DIGIT, OTHER = range(4)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each byte, whether it is odd) in UTF-8.

    U+00C0 to U+024F, whose first bytes are C3 to C9, are letters but for two signs; a
    unit with other characters beyond ASCII, control characters, quotes or the first
    character of a special token is odd: it reaches from one white space to the next.
    """
    b = np.arange(256)
    letter = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122) | (b >= 128)
    kind = np.select([BLANK, letter, (b >= 48) & (b <= 57)], [SPACE, LETTER, DIGIT], OTHER)
    odd = (b < 9) | (b >= 14) & (b < 32) | (b == 127) | (b >= 0xC0) & ((b < 0xC3) | (b > 0xC9)) | (b == ord("'"))
    return kind.astype(np.uint8), odd


KIND, ODD = _byte_kinds()


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends: pieces of text to ids and back."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 20 | ids[b]] = k
            self.merged.append(ids[a + b])
        chars = _byte_characters()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + self.end] for c in chars]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre_tokens = regex.compile(split["pattern"]["Regex"]).findall
        #: Whether letters, digits and others make units of their own; bytes that make a unit odd.
        self.plain = split["pattern"]["Regex"] in SPLITS
        self.odd = ODD.copy()
        self.odd[[t.encode()[0] for t in self.special]] = True
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.bytes_of = {c: b for b, c in enumerate(chars)}

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if len(parts) > SHORT:
            return self._long(parts)
        get, merged = self.rank.get, self.merged
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same merges by a heap of (rank, place) over linked parts, for words of many parts."""
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i):
            j = right[i]
            if j >= 0 and (k := self.rank.get(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(heap, (k, i, parts[i], j, parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            k, i, a, j, b = heapq.heappop(heap)
            if parts[i] != a or right[i] != j or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[k], -1
            right[i] = right[j]
            right[j] = -1
            if right[i] >= 0:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p >= 0]

    def pre_tokens_of(self, unit: str) -> list[bytes]:
        """Pre-tokens of a unit without special tokens, in UTF-8."""
        if unit.isascii() and unit.isprintable():
            return [t.encode() for t in self.pre_tokens(unit.lower())]
        tokens = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))
        return [bytes(map(self.bytes_of.__getitem__, t)) for t, _ in tokens]

    def unit(self, unit: str) -> list[int]:
        """Ids of a unit, in which strings of special tokens may stand for these."""
        out: list[int] = []
        for k, part in enumerate(self.specials.split(unit) if self.specials else [unit]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for token in self.pre_tokens_of(part):
                    out += self.word(token)
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts of units, their ends, whether they are odd, units before each text and at the end) of BINARY texts."""
        data, bounds = bytes_of(texts)
        n = len(data)
        kind = KIND.take(data)
        solid = kind != SPACE
        inner = bounds[(bounds > 0) & (bounds < n)]
        change = np.ones(n + 1, bool)
        blank = change.copy()  # where white space begins or ends
        np.not_equal(solid[1:], solid[:-1], out=blank[1:n])
        blank[inner] = True
        edges = np.flatnonzero(blank[:-1])
        edges = edges[solid[edges]] if n else edges
        odd = self.odd.take(data)
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the two signs among the letters
        if self.plain:
            np.not_equal(kind[1:], kind[:-1], out=change[1:n])
            change[:n] |= kind == DIGIT
            change[inner] = True
        else:
            change = blank
        cuts = np.flatnonzero(change)
        first = solid[cuts[:-1]]
        starts, stops = cuts[:-1][first], cuts[1:][first]
        strange = np.zeros(len(starts), bool)
        places = np.flatnonzero(odd & solid)
        if len(places):
            word = np.unique(np.searchsorted(edges, places, side="right") - 1)
            marked = np.zeros(len(edges) + 1, bool)
            marked[word] = True
            strange = marked[np.searchsorted(edges, starts, side="right") - 1]
            head = np.isin(starts, edges[word], assume_unique=True)
            # a strange unit ends where the next white space does begin, or the text
            ends = np.flatnonzero(blank)
            after = np.searchsorted(ends, starts[head], side="right")
            stops[head] = ends[after]
            keep = ~strange | head
            starts, stops, strange = starts[keep], stops[keep], strange[keep]
        return data, starts, stops, strange, np.searchsorted(starts, bounds)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces, which is how a vocabulary without a decoder is read back."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Units:
    """Ids of the units met lately, encoded by `encode` (units as text to lists of ids); forgets all at REMEMBERED."""

    def __init__(self, vocabulary: Vocabulary, encode):
        self.vocabulary, self.encode = vocabulary, encode
        self.clear()

    def clear(self) -> None:
        self.table, self.first, self.flat = HashTable(), np.zeros(1, np.int64), np.empty(0, "<u4")

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        ids = self.encode([u.decode("utf-8", "replace") for u in units])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.table.add(hashes)
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(ends[-1]))])

    def ids(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """BINARY ids of BINARY texts, each with `end` behind."""
        data, starts, stops, strange, ends = self.vocabulary.cut(texts)
        hashes = hash_words(LOWER.take(data), starts, stops)
        if strange.any():
            hashes[strange] = ~hash_words(data, starts[strange], stops[strange])
        at = self.table.find(hashes)
        if (at < 0).any():
            if self.table.count > REMEMBERED:
                self.clear()
                at[:] = -1
            missing = np.flatnonzero(at < 0)
            new, index = np.unique(hashes[missing], return_index=True)
            own = missing[index]
            self._learn([data[a:b].tobytes() for a, b in zip(starts[own].tolist(), stops[own].tolist())], new)
            at = self.table.find(hashes)
        first = self.first[at]
        sizes = self.first[at + 1] - first
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.arange(before[-1]) + np.repeat(first - before[:-1], sizes)]
        stops = before[ends]
        if end:
            flat = np.insert(flat, stops[1:], np.frombuffer(end, "<u4")[0])
            stops = stops + np.arange(len(stops))
        return binary_of(flat, stops * 4)


class Held:
    """A vocabulary and the units known by it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel as it is
        self.vocabulary, self.by = Vocabulary(path), {}

    def units(self, name: str, make) -> Units:
        if name not in self.by:
            self.by[name] = make(self.vocabulary)
        return self.by[name]


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary, whichever units it has at hand."""
    return cache(path, lambda: Held(path)).vocabulary


def own_units(path: str) -> Units:
    """Units encoded by the rank arrays of this module."""

    def make(v):
        return Units(v, lambda units: [v.unit(u) for u in units])

    return cache(path, lambda: Held(path)).units("own", make)


def library_units(path: str) -> Units:
    """Units encoded by the tokenizers library: pre-tokens of Latin letters by its model, others from the text."""

    def make(v):
        model, chars = v.library.model, dict(enumerate(_byte_characters()))
        # letters that normalising only lowers, one by one
        ascii, latin = re.compile("[A-Za-z]+|[0-9]").fullmatch, re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+").fullmatch

        def pre_token(unit):
            if ascii(unit):
                return unit.lower()
            return unit.lower().encode().decode("latin-1").translate(chars) if latin(unit) else None

        def encode(units):
            tokens = map(pre_token, units) if v.plain else [None] * len(units)
            out = [None if t is None else [x.id for x in model.tokenize(t)] for t in tokens]
            rest = [k for k, x in enumerate(out) if x is None]
            for k, x in zip(rest, v.library.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)):
                out[k] = x.ids
            return out

        return Units(v, encode)

    return cache(path, lambda: Held(path)).units("library", make)


def _column(texts: pa.Array, units: Units, end: bytes = b"") -> pa.Array:
    parts = [units.ids(part, end) for part in by_bytes(texts, TEXT_BYTES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encode(text: Column | str, path: str) -> Column:
    """Ids of each text as BINARY (see the module's docstring); null and blank texts give an empty value."""

    @F.arrow_udf("binary")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return _column(texts, own_units(path))

    return bpe_encode(raw(text))


def library_encode(text: Column | str, path: str, end: bytes = b"") -> Column:
    """The same ids by way of the tokenizers library, each text's with the id `end` behind."""

    @F.arrow_udf("binary")
    def encode_by_library(texts: pa.Array) -> pa.Array:
        return _column(texts, library_units(path), end)

    return encode_by_library(raw(text))


def library_encoder(path: str, end: bytes):
    """A function from BINARY texts to ids, each with the id `end` behind, for operators that encode inside their own tasks."""

    def run(texts: pa.Array) -> pa.Array:
        return _column(texts, library_units(path), end)

    return run


def decode(ids: Column | str, path: str) -> Column:
    """Text of ids in BINARY; no ids, or null, give the empty text."""

    @F.arrow_udf("string")
    def bpe_decode(values: pa.Array) -> pa.Array:
        text = vocabulary(path).decode
        return pa.array([text(np.frombuffer(v.as_py(), "<u4").tolist()) for v in values], pa.string())

    return bpe_decode(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.lit(b"")))


def round_trip(text: Column | str, path: str) -> Column:
    """STRUCT of ids and decoded: encode and decode in one pass, which holds one vocabulary per worker."""

    @F.arrow_udf("ids binary, decoded string")
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        ids = _column(texts, own_units(path))
        decode_ids = vocabulary(path).decode
        decoded = pa.array([decode_ids(np.frombuffer(v.as_py(), "<u4").tolist()) for v in ids], pa.string())
        return pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return bpe_round_trip(raw(text))
