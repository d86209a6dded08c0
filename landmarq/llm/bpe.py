"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, in one pass over a word,
the longest token that starts at each place. The encoder takes the longest
token that may follow the last one and steps back to a shorter prefix, or to the
token before, when none may. Whether two tokens may stand side by side is a
property of the pair alone: undoing their merges, latest first, no merge across
the border may come earlier than the merges that made them. Each place
is left at most once for each token that ends there, so a word takes time in
proportion to its length, and the result is the one that merging in order of
rank gives.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Stands for the mark of a word's end inside keys; the byte alphabet has no such character.
_END = "\ue000"
#: Entries of each of the two generations of a worker's cache of encoded words, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
# Letters and numbers assigned after Unicode 16, which the library takes for marks and the pattern module doesn't.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
_LATER_SIGNS = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER) + "]")
_MARKS = string.punctuation
_UNICODE_SPACE = regex.compile(r"\p{White_Space}+")
#: Characters that str.split() takes for white space and Unicode doesn't.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A tokenizer file of normaliser NFC and lower case, a splitting pattern, a byte alphabet and merges with a word-end mark.

    Null or empty text gives no tokens. Special tokens' strings in a text give
    their ids.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        compiled = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.pieces, self.spans = compiled.findall, compiled.finditer
        self.specials = regex.compile("|".join(map(regex.escape, self.special))).finditer if self.special else None
        self.alphabet = byte_alphabet()
        # Keys mark a word's end by structure, so that "</w>" typed in a text is no mark.
        keys: dict[int, str] = {}
        for char in self.alphabet:
            keys[vocab[char]], keys[vocab[char + suffix]] = char, char + _END
        self.merged: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {i: (i, i) for i in keys}
        self.rank: dict[int, int] = dict.fromkeys(keys, -1)
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = vocab[left], vocab[right]
            i = vocab[left.removesuffix(suffix) + right if left.endswith(suffix) and a in keys and keys[a].endswith(_END) else left + right]
            self.merged[a, b], self.made_of[i], self.rank[i] = i, (a, b), rank
            keys[i] = keys[a] + keys[b]
        usable: set[int] = set()
        for i in sorted(keys, key=self.rank.get):  # parts before what is made of them; a token that no text merges into is left out
            a, b = self.made_of[i]
            if a == b == i or a in usable and b in usable and self._stays(a, b, i):
                usable.add(i)
        by_key = {keys[i]: i for i in usable}
        self.length = {i: len(k) for k, i in by_key.items()}
        self.shorter = {i: next((by_key[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in by_key), None) for k, i in by_key.items()}
        self.automaton = ahocorasick.Automaton()
        for key, i in by_key.items():
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Decoding joins the tokens' strings by spaces: each has one ahead of it. Token i lies at offsets[i]:offsets[i + 1].
        strings = [(" " + self.names.get(i, "")).encode() for i in range(max(self.names) + 1)]
        self.offsets = [0, *itertools.accumulate(map(len, strings))]
        blob = b"".join(strings)
        self.slices = [blob[a:b] for a, b in itertools.pairwise(self.offsets)]

    def _stays(self, first: int, second: int, target: int | None = None) -> bool:
        """Whether merging by rank leaves ``first`` and ``second`` side by side, until they merge into ``target`` if that is given."""
        # What lies left and right of the border before each of the merges that made the two, latest first.
        left, right, bound = first, second, len(self.rank) if target is None else self.rank[target]
        while True:
            across = self.merged.get((left, right))
            if across is not None and across != target and self.rank[across] < bound:
                return False
            rank_left, rank_right = self.rank[left], self.rank[right]
            if rank_left < 0 and rank_right < 0:
                return True
            # Of two equal pairs the left one merges first, so a border pair beats an equal merge on its right only.
            if rank_left > rank_right:
                bound, left = rank_left, self.made_of[left][1]
            else:
                bound, right = rank_right + 1, self.made_of[right][0]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Adds the pair to the table of compatible pairs."""
        if len(self.compatible) >= 200_000:
            self.compatible.clear()
        fits = self.compatible[pair] = self._stays(*pair)
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of normalised text."""
        if word.isascii() and word.isprintable():  # the alphabet has these for themselves
            key = word + _END
        else:
            alphabet = self.alphabet
            key = "".join([alphabet[b] for b in word.encode()]) + _END
        size = len(key)
        longest: list[int | None] = [None] * (size + 1)
        for end, (token, length) in self.automaton.iter(key):
            longest[end - length + 1] = token  # later ends, so longer tokens, come later
        open_at = bytearray(b"\x01") * (size + 1)
        open_at[size - 1] = 0  # no token is the end mark alone
        tokens: list[int] = []
        at, token = 0, longest[0]
        lengths, shorter, known = self.length, self.shorter, self.compatible
        while at < size:
            if token is None:
                # Nothing fits here any more: leave this place for good and shorten the token before.
                open_at[at] = 0
                token = tokens.pop()
                at -= lengths[token]
                token = shorter[token]
                continue
            end = at + lengths[token]
            fits = open_at[end]
            if fits and tokens:
                pair = tokens[-1], token
                fits = known.get(pair)
                if fits is None:
                    fits = self._fits(pair)
            if fits:
                tokens.append(token)
                at, token = end, longest[end]
            else:
                token = shorter[token]
        return tokens

    def _encode_plain(self, text: str) -> list[int]:
        if text.isascii():
            text = text.lower()
            word = text.rstrip(_MARKS)
            if word.isalpha():  # one word and the marks behind it: what the pattern gives, without asking it
                return self.encode_word(word) + self.encode_word(text[len(word) :]) if len(word) < len(text) else self.encode_word(word)
            return [i for piece in self.pieces(text) for i in self.encode_word(piece)]
        # Lower case goes character by character: a final sigma is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if _LATER_SIGNS.search(text):
            plain = _LATER_SIGNS.sub("\ufffd", text)
            return [i for span in self.spans(plain) for i in self.encode_word(text[span.start() : span.end()])]
        return [i for piece in self.pieces(text) for i in self.encode_word(piece)]

    def _encode_chunk(self, chunk: str) -> bytes:
        ids, at = [], 0
        if self.specials and "<" in chunk:
            for found in self.specials(chunk):
                ids += [*self._encode_plain(chunk[at : found.start()]), self.special[found[0]]]
                at = found.end()
        ids += self._encode_plain(chunk[at:])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = text.split() if not _ODD_SPACE.search(text) else [x for x in _UNICODE_SPACE.split(text) if x]
        cache, out = self.cache, []
        for chunk in chunks:
            ids = cache.get(chunk)
            if ids is None:
                ids = self.older.get(chunk)
                if ids is None:
                    ids = self._encode_chunk(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:  # words that stay in use outlive a change of generations
                        self.older, cache = cache, {}
                        self.cache = cache
                    cache[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, joined by spaces."""
        return b"".join([self.slices[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


@lru_cache(maxsize=2)
def tokenizer(definition: str) -> Tokenizer:
    """A worker's tokenizer; tasks that share a worker share it and its cache."""
    return Tokenizer(definition)


def _definition(spark, path: str):
    """The tokenizer file (a few MB whatever the input) for all executors."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, an array) for every row of ``docs``.

    Each whole text is encoded, and its ids are decoded again by the offset
    table. Null and empty texts have no tokens: the digests are those of
    nothing. Repeated rows come back as often as they came. Other columns are
    ignored. Memory is bounded by the longest text and the word cache.
    """
    ship(docs.sparkSession)
    definition = _definition(docs.sparkSession, path)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                coded = [coder.encode(x.as_py()) for x in part.column(1)]
                columns = [
                    part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded]),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return narrow.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with ``out_col``, the text of the ids in ``ids_col`` (null for null)."""
    ship(coded.sparkSession)
    definition = _definition(coded.sparkSession, path)
    base = coded.drop(out_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(definition.value)
        for batch in batches:
            texts = [None if x.as_py() is None else coder.decode(np.array(x.as_py(), "<u4").tobytes()).decode() for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return base.mapInArrow(scan, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{out_col}` string"]))
