"""Token ids of texts, with the library ``tokenizers``.

A text is cut at white space where the tokenizer cuts it anyway (line breaks too), and the ids of each part are kept:
most parts of a corpus come again and again. Texts in which such a cut might not be the tokenizer's (special tokens, rare
white space, spaces side by side) are encoded whole, so the ids are those of ``encode(text, add_special_tokens=False)``.

The distinct parts of some megabytes of texts are looked up in the kept parts, which are a column and take some 40 bytes
each (as objects, some 320).
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit

# White space that is not ASCII, and separators that some definitions count as white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A line break alone between words is a token of its own, with nothing around it.
LINE_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
SPACES_TOGETHER = ("  ", "\t ", "\n ", "\x0b ", "\x0c ", "\r ")
KEPT_PARTS = 900_000
PUNCTUATION = ".,;:!?*#%&$|"
PLAIN = "\0"  # marks a part without a space before it
TEXT_BYTES = 1 << 22  # of texts whose words are looked up at a time, ...
WORDS_TOGETHER = 1 << 19  # ... and words
WHOLE_TEXT = f"<\\||\\x00|{ODD_SPACE.pattern}"  # texts that are not cut into words

BYTE_LEVEL, WORD_LEVEL = "byte", "word"
LAST_PLAIN_LETTER = "\u024f"  # up to here, letters are composed and have one lower case
NOT_PLAIN = "\u0130"
PLAIN_LETTERS = "".join(c for c in map(chr, range(ord(LAST_PLAIN_LETTER) + 1)) if c.isalpha() and c != NOT_PLAIN)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


def sized(batch: pa.RecordBatch, column: str, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes in a column."""
    taken = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(taken, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def together(texts: list[str], size: int = TEXT_BYTES) -> Iterator[list[str]]:
    """The texts in lists of about ``size`` characters."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def taken(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``at``, one after the other, and how many each has; piece i starts at ``starts[i]``."""
    sizes = np.diff(starts)[at]
    place = np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes)
    place += np.arange(len(place))
    return ids[place], sizes


class KeptWords:
    """Ids of words; those of the ``KEPT_PARTS`` words or so that are seen first are kept, in flat arrays."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, "<u4")
        self.starts = np.zeros(1, np.int64)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        coded = words.dictionary_encode()
        place = pc.index_in(self.words, value_set=coded.dictionary)
        at = np.full(len(coded.dictionary), -1, np.int64)
        at[place.drop_null().to_numpy()] = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        missing = np.flatnonzero(at < 0)
        at[missing] = len(self.words) + np.arange(len(missing))
        fresh = coded.dictionary.take(pa.array(missing))
        found, sizes = self.encode(fresh)
        ids = np.concatenate([self.ids, found])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        if len(self.words) < KEPT_PARTS and len(fresh):  # the words seen first are the common ones
            self.words, self.ids, self.starts = pa.concat_arrays([self.words, fresh]), ids, starts
        return taken(ids, starts, at[coded.indices.to_numpy()])


class Encoder:
    """Ids, as little-endian unsigned 32-bit integers, of a tokenizer file.

    ``kind`` is byte for tokenizers that keep a space with the word after it, word for those that
    drop white space.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = kind
        self.words = KeptWords(self.fresh_words if kind == WORD_LEVEL else self.fresh_parts)

    def whole(self, texts: list[str]) -> list[bytes]:
        encodings = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encodings]

    def word(self, part: str) -> bytes | None:
        """Ids of a part that is one plain word, by the tokenizer's model; None if it is not.

        The word is not normalized and not split, so the model alone does.
        """
        plain = part[1:] if part.startswith(PLAIN) else part
        if not plain.isalpha() or max(plain) > LAST_PLAIN_LETTER or NOT_PLAIN in plain:
            return None
        return self.plain_ids(plain, not part.startswith(PLAIN))

    def plain_ids(self, plain: str, space: bool = False) -> bytes:
        """Ids of plain letters, lower case for a word-level tokenizer, after a space."""
        if not plain.isascii():
            plain = "".join([BYTE_CHARACTERS[b] for b in plain.encode()])
        if space:
            plain = BYTE_CHARACTERS[32] + plain
        ids = array("I", [t.id for t in self.model.tokenize(plain)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def parts(self, text: str) -> list[str] | None:
        """Parts that are encoded independently; None if the text must be encoded whole."""
        if "<|" in text or ODD_SPACE.search(text):
            return None
        if any(s in text for s in SPACES_TOGETHER):
            return None
        if "\n" in text:
            text = LINE_BREAK.sub(f" {PLAIN}\n {PLAIN}", text)
        first, *rest = text.split(" ")
        # A part stands for itself after a space; the first has none, which the mark tells.
        return [PLAIN + first, *rest] if first else rest

    def fresh_parts(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``KeptWords.ids_of``, of distinct parts; trailing punctuation after letters is a token of its own."""
        parts = distinct.to_pylist()
        cores = {p: p.rstrip(PUNCTUATION) for p in parts}
        split = {p: p[len(c) :] for p, c in cores.items() if c != p and c.isalpha()}
        wanted = {cores[p] if p in split else p for p in parts} | {PLAIN + tail for tail in split.values()}
        found = {p: ids for p in wanted if (ids := self.word(p)) is not None}
        others = [p for p in wanted if p not in found]
        texts = [p[1:] if p.startswith(PLAIN) else " " + p for p in others]
        found.update(zip(others, self.whole(texts), strict=True))
        ids = [found[cores[p]] + found[PLAIN + split[p]] if p in split else found[p] for p in parts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), sizes

    def fresh_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``KeptWords.ids_of``, of distinct words; trailing punctuation after letters is a token of its own."""
        tails = pc.utf8_ltrim(words, PLAIN_LETTERS)
        cores = pc.utf8_rtrim(words, PUNCTUATION)
        split = pc.and_(pc.equal(pc.utf8_rtrim(tails, PUNCTUATION), ""), pc.not_equal(cores, ""))
        cores = pc.utf8_lower(cores.filter(split)).dictionary_encode()
        tails = tails.filter(split).dictionary_encode()
        plain = [self.plain_ids(x) for x in cores.dictionary.to_pylist()]
        ends, others = (self.whole(x.to_pylist()) for x in (tails.dictionary, words.filter(pc.invert(split))))
        pieces = [*plain, *ends, *others, b""]
        at = np.full((len(words), 2), len(pieces) - 1)  # a word has two pieces, or one and the empty one
        split = split.to_numpy(zero_copy_only=False)
        at[split, 0], at[split, 1] = cores.indices.to_numpy(), tails.indices.to_numpy() + len(plain)
        at[~split, 0] = np.arange(len(others)) + len(plain) + len(ends)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)
        ids, sizes = taken(np.frombuffer(b"".join(pieces), "<u4"), np.concatenate([[0], ends]), at.ravel())
        return ids, sizes.reshape(-1, 2).sum(1)

    def encode_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts of a word-level tokenizer."""
        uncut = pc.match_substring_regex(texts, WHOLE_TEXT)
        whole = iter(self.whole(texts.filter(uncut).to_pylist()))
        cut = pc.ascii_split_whitespace(texts.filter(pc.invert(uncut)))
        found = self.cut_at(cut.flatten(), pc.list_value_length(cut).to_pylist())
        return [next(whole) if x else next(found) for x in uncut.to_pylist()]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As ``encode``, of a column of strings without nulls."""
        if self.kind != WORD_LEVEL:
            return self.encode(texts.to_pylist())
        parts = sized(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
        return [ids for part in parts for ids in self.encode_words(part.column("text"))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == WORD_LEVEL:
            return self.encode_column(pa.array(texts, pa.string()))
        return [ids for some in together(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if PLAIN in t else self.parts(t) for t in texts]
        whole = iter(self.whole([t for t, p in zip(texts, cut, strict=True) if p is None]))
        parts = pa.array([x for p in cut if p is not None for x in p], pa.string())
        found = self.cut_at(parts, [len(p) for p in cut if p is not None])
        return [next(whole) if p is None else next(found) for p in cut]

    def cut_at(self, words: pa.Array, numbers: list[int]) -> Iterator[bytes]:
        """Ids of texts that have so many of the words."""
        made = [self.words.ids_of(words.slice(i, WORDS_TOGETHER)) for i in range(0, len(words), WORDS_TOGETHER)]
        ids = np.concatenate([np.zeros(0, "<u4"), *[ids for ids, _ in made]])
        sizes = np.concatenate([np.zeros(1, np.int64), *[sizes for _, sizes in made]])
        bounds = np.cumsum(sizes)[np.cumsum([0, *numbers])].tolist()
        return (ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True))


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder; workers are used again by later tasks."""
    return Encoder(path, kind)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
