"""Token ids of whole texts by a public tokenizer that never joins characters across white space.

Texts are split and their chunks dictionary-encoded in Arrow, so each distinct chunk is looked up once and the rest is a
gather. This equals encoding the whole text because the vocabulary's splitting pattern has no match that spans white space.
The pattern of the default vocabulary also parts letters from the marks after them, so there a chunk of letters and marks
is put together from those two, and words are encoded many at a time: each ends with an id that only ends words have.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunks_of, text_parts

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.lru_cache(maxsize=2)
def tokenizer_at(path: str, literal: bool):
    """(tokenizer, which ids end a word); a worker process reads a vocabulary once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = literal
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
    return tokenizer, ends


class IdLists:
    """Lists of ids by key, one after another in ``flat``; keys and ids are Arrow and numpy arrays."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.large_binary())
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
        self.flat = np.concatenate((self.flat, ids))

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where each of ``keys`` stands, -1 if nowhere."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy()

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the given places, one after another, and where each place's begin and the last one's end."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(rows))
        return lists.values.to_numpy(), lists.offsets.to_numpy()

    def keep(self, keys: pa.Array) -> None:
        """Forgets all but what ``keys`` has."""
        rows = np.unique(self.places(keys))
        rows = rows[rows >= 0]
        self.flat, self.ends = self.taken(rows)
        self.keys = self.keys.take(pa.array(rows))


def cut_off(whole: pa.Array, front: pa.Array) -> pa.Array:
    """What is left of each of ``whole`` behind its beginning in ``front``."""
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    rest = np.diff(offsets) - pc.binary_length(front).to_numpy()
    ends = np.concatenate(([0], np.cumsum(rest))).astype(np.int64)
    at = np.repeat(offsets[1:] - ends[1:], rest) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(data[at])])


class ChunkTokenizer:
    """Belongs to one task. It keeps the ids of the chunks and words it met; beyond ``limit`` only those that come again at once.

    ``literal``: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str | None = None, literal: bool = False, limit: int = 500_000):
        import public_tokenizers

        self.tokenizer, self.ending = tokenizer_at(path or public_tokenizers.path("word_bpe_49k.json"), literal)
        self.parted = path is None
        self.limit = limit
        self.chunks, self.words = IdLists(), IdLists()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for texts of letters only or of marks only."""
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ending[got]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(some) or ends[-1] != len(got):  # a character that the vocabulary takes for another kind
                got, n = self.encode(some)
            ids.append(got), lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, chunks: pa.Array) -> None:
        try:
            texts = chunks.cast(pa.large_string())
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([c.decode("utf-8", "replace") for c in chunks.to_pylist()], pa.large_string())
        if not self.parted:
            self.chunks.add(chunks, *self.encode(texts.to_pylist()))
            return
        stems = pc.utf8_rtrim(texts, characters=MARKS)
        plain = pc.or_(pc.utf8_is_alpha(stems), pc.equal(stems, ""))
        fronts = pc.if_else(plain, stems, texts)
        tails = cut_off(texts, fronts)
        fronts = pc.if_else(pc.and_(plain, pc.string_is_ascii(fronts)), pc.ascii_lower(fronts), fronts).cast(pa.large_binary())
        coded = pa.concat_arrays([fronts, tails]).dictionary_encode()
        distinct = coded.dictionary
        if len(self.words.keys) > self.limit:
            self.words.keep(distinct)
        place = self.words.places(distinct).copy()
        new = np.flatnonzero(place < 0)
        rest = distinct.take(pa.array(new))
        odd = pc.is_in(rest, value_set=texts.filter(pc.invert(plain)).cast(pa.large_binary())).to_numpy(zero_copy_only=False)
        empty = pc.equal(rest, b"").to_numpy(zero_copy_only=False)
        nothing = lambda words: (np.empty(0, np.uint32), np.zeros(len(words), np.int64))
        for own, encode in ((new[~odd & ~empty], self.encode_words), (new[odd & ~empty], self.encode), (new[empty], nothing)):
            if len(own):
                part = distinct.take(pa.array(own))
                place[own] = np.arange(len(self.words.keys), len(self.words.keys) + len(own))
                self.words.add(part, *encode(part.cast(pa.large_string()).to_pylist()))
        rows = place[coded.indices.to_numpy()]
        ids, ends = self.words.taken(np.stack((rows[: len(chunks)], rows[len(chunks) :]), axis=1).ravel())
        self.chunks.add(chunks, ids, np.diff(ends[::2]))

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, as unsigned 32-bit numbers; none for null."""
        held: list[np.ndarray] = []
        row = -1
        for rows, parts in text_parts(texts):
            offsets, codes, distinct = chunks_of(parts)
            if len(self.chunks.keys) > self.limit:
                self.chunks.keep(distinct)
            found = self.chunks.places(distinct)
            new = found < 0
            if new.any():
                found = found.copy()
                found[new] = np.arange(len(self.chunks.keys), len(self.chunks.keys) + new.sum())
                self.learn(distinct.filter(pa.array(new)))
            ids, ends = self.chunks.taken(found[codes])
            ends = ends[offsets].tolist()
            for r, s, e in zip(rows.tolist(), ends, ends[1:], strict=False):
                if r != row:
                    if row >= 0:
                        yield held[0] if len(held) == 1 else np.concatenate(held)
                    held, row = [], r
                held.append(ids[s:e])
        if row >= 0:
            yield held[0] if len(held) == 1 else np.concatenate(held)
