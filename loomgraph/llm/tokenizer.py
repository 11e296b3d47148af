"""Byte-level BPE of a tokenizer file, pre-token by pre-token.

No merge crosses a pre-token, so the ids of a text are those of its pre-tokens one after the other.  The merges are
ranked by id in such files, so tiktoken's merge loop gives the same ids; tests hold both libraries against each other.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

# The white space of the Unicode property White_Space, and the tokenizer's published split pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{W}{LN}]+|[{W}]+(?![^{W}])|[{W}]+"

#: Texts of these characters alone take the faster of two equal patterns.
_PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_FAST = re.compile(SPLIT.replace("{W}", WHITE).replace("{LN}", _PLAIN_LETTERS + "0-9").replace("{L}", f"[{_PLAIN_LETTERS}]").replace("{N}", "[0-9]"))
_FULL = regex.compile(SPLIT.replace("{W}", WHITE).replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))


def pre_tokens(text: str) -> list[str]:
    return (_FULL if _OTHER.search(text) else _FAST).findall(text)


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level tokenizer files write for bytes: printable ones stand for themselves,
    the others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes.  Holds at most `most` of them; the others are
    computed each time."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_characters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.most, self.size = most, max([*ranks.values(), *self.special.values()]) + 1
        self.of_id = {v: k for k, v in ranks.items()}
        self._encode = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self._encode(token.encode("utf-8")), "<u4").tobytes()
        if len(self) < self.most and len(token) <= 64:
            self[token] = ids
        return ids

    def count(self, token: bytes) -> int:
        """The number of pieces of one pre-token, given as UTF-8."""
        return len(self._encode(token))

    def parts(self, text: str) -> list[str]:
        """The text between special strings, and those strings, in turn."""
        if self._cut is None or not any(s in text for s in self.special):
            return [text]
        return [x for x in self._cut.split(text) if x]

    def ids(self, text: str) -> bytes:
        """All ids of a text, special strings read as their ids."""
        out = []
        for part in self.parts(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(self.__getitem__, pre_tokens(part))
        return b"".join(out)


@lru_cache(maxsize=2)
def pieces(path: str, most: int = 200_000) -> Pieces:
    """One per worker process."""
    return Pieces(path, most)


# Fixed value: the published split pattern of the word tokenizer, white space left out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{W}{LN}]+"
_LOW_LETTERS = "a-zß-öø-ÿ"
_FAST_WORDS = re.compile(WORDS.replace("{W}", WHITE).replace("{LN}", _LOW_LETTERS + "0-9").replace("{L}", f"[{_LOW_LETTERS}]").replace("{N}", "[0-9]"))
_FULL_WORDS = regex.compile(WORDS.replace("{W}", WHITE).replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
#: Beyond these characters Python's white space or lower case may differ from the library's.
_OTHER_WORDS = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
#: Characters of plain texts whose runs are told apart together.
PLAIN_CHARACTERS = 8_000_000


class WordPieces(dict):
    """Word -> its ids, for a tokenizer file whose texts are normalised, lower-cased and cut into words, with white
    space dropped; ids as little-endian bytes of 16 bits, or 32 where the vocabulary needs them.

    No word holds white space, so the ids of a text are those of the runs between it, and `runs` holds those of runs
    already seen.  The library's own normaliser reads texts beyond Latin letters, and its own model each new word.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.kind, self.most = np.dtype("<u2" if self.size <= 1 << 16 else "<u4"), most
        library = Tokenizer.from_file(path)
        self._normal, self._model = library.normalizer, library.model
        self._stand_in = {b: c for c, b in _byte_characters().items()}
        self._packed = [struct.Struct(f"<{n}{'H' if self.kind.itemsize == 2 else 'I'}").pack for n in range(65)]
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.runs = _Runs(self)

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable() and " " not in word  # bytes that stand for themselves
        level = word if plain else "".join(map(self._stand_in.__getitem__, word.encode("utf-8")))
        found = [t.id for t in self._model.tokenize(level)]
        ids = self._packed[len(found)](*found) if len(found) < len(self._packed) else np.array(found, self.kind).tobytes()
        if len(self) < self.most and len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text, special strings read as their ids."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._part(text)
        return b"".join(np.array([self.special[x]], self.kind).tobytes() if x in self.special else self._part(x) for x in self._cut.split(text))

    def _part(self, text: str) -> bytes:
        if _OTHER_WORDS.search(text):
            return b"".join(map(self.__getitem__, _FULL_WORDS.findall(self._normal.normalize_str(text))))
        return b"".join(map(self.runs.__getitem__, text.lower().split()))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """ids() of each text.  The runs of the plain ones are found and told apart by Arrow, so a run is looked up once
        however often it occurs in them, and put in place by index."""
        out: list = [None] * len(texts)
        plain, held = [], 0
        for i, t in enumerate(texts):
            if _OTHER_WORDS.search(t) or any(s in t for s in self.special):
                out[i] = np.frombuffer(self.ids(t), self.kind)
                continue
            plain.append(i)
            held += len(t)
            if held > PLAIN_CHARACTERS:
                self._put(out, plain, texts)
                plain, held = [], 0
        if plain:
            self._put(out, plain, texts)
        return out

    def _put(self, out: list, plain: list[int], texts: list[str]) -> None:
        lists = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
        runs = lists.values.dictionary_encode()
        known = list(map(self.runs.__getitem__, runs.dictionary.to_numpy(zero_copy_only=False).tolist()))
        flat = np.frombuffer(b"".join(known), self.kind)
        sizes = np.array([len(x) for x in known], np.int64) // self.kind.itemsize
        starts, at = np.cumsum(sizes) - sizes, runs.indices.to_numpy()
        n = sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(starts[at] - ends[:-1], n) if len(at) else np.zeros(0, np.int64)
        places += np.arange(len(places))
        ids, edges = flat[places], ends[lists.offsets.to_numpy()]
        for i, a, b in zip(plain, edges.tolist(), edges[1:].tolist(), strict=False):
            out[i] = ids[a:b]


class _Runs(dict):
    """Run of characters without white space, lower case -> the ids of its words."""

    def __init__(self, words: WordPieces):
        super().__init__()
        self.words = words

    def __missing__(self, run: str) -> bytes:
        # Of the characters of plain texts all that are letters to Python are letters to the pattern.
        ids = self.words[run] if run.isalpha() else b"".join(map(self.words.__getitem__, _FAST_WORDS.findall(run)))
        if len(self) < self.words.most and len(run) <= 64:
            self[run] = ids
        return ids


@lru_cache(maxsize=2)
def word_pieces(path: str, most: int = 500_000) -> WordPieces:
    """One per worker process."""
    return WordPieces(path, most)
