"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum over all ways to cut it into pieces, which a forward pass over its characters gives; a text's is the product over
its words. Texts are split and their chunks dictionary-encoded in Arrow; each distinct chunk is scored once, and a text's
score is a sum over what its chunks point to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_fraction, chunks_of, map_in_python, sampled, text_parts, with_columns_from_python

UNDETERMINED = "und"


def load_pieces(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


def letters_of(chunk: str) -> list[str]:
    """Lower-cased maximal runs of letters in a chunk without white space."""
    chunk = chunk.lower()
    return [chunk] if chunk.isalpha() else "".join(c if c.isalpha() else " " for c in chunk).split()


@dataclass
class LanguageModel:
    """languages in order; pieces: text -> row of ``logp``, whose last row is for a character no piece covers."""

    languages: list[str]
    pieces: dict[str, int]
    logp: np.ndarray
    prior: np.ndarray

    @property
    def piece_limit(self) -> int:
        """Characters of the longest piece."""
        return max(map(len, self.pieces), default=1)

    def tables(self) -> tuple[list[tuple[pa.Array, np.ndarray]], np.ndarray]:
        """By length of piece: the pieces' hashes and rows of the second, the pieces' probabilities; its last row is no piece."""
        by_length: dict[int, list[str]] = {}
        for piece in self.pieces:
            by_length.setdefault(len(piece), []).append(piece)
        found_in = []
        for size in range(1, self.piece_limit + 1):
            own = by_length.get(size, [])
            *_, h = spans(codes_of(own, size), size)
            found_in.append((pa.array(h.ravel()), np.array([self.pieces[p] for p in own] + [len(self.pieces) + 1], np.int32)))
        return found_in, np.vstack([np.exp(self.logp), np.zeros((1, self.logp.shape[1]))])

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """A function from words to log P(word | language), summed over all segmentations; [words, languages]."""
        found_in, probability = self.tables()
        unknown, none, limit, languages = len(self.pieces), len(self.pieces) + 1, self.piece_limit, len(self.languages)

        def pieces_in(codes: np.ndarray) -> list[np.ndarray]:
            """For each length the row of the piece that begins at each place of each word."""
            out = []
            for (hashes, rows), h in zip(found_in, spans(codes, min(limit, codes.shape[1])), strict=False):
                at = pc.fill_null(pc.index_in(pa.array(h.ravel()), value_set=hashes), len(hashes)).to_numpy()
                ids = rows[at].reshape(h.shape)
                out.append(np.where(ids == none, unknown, ids) if not out else ids)
            return out

        def forward(block: list[str]) -> np.ndarray:
            """Of words in the order of length."""
            n = np.array([len(w) for w in block]) + 1
            last = int(n[-1])
            ids = pieces_in(codes_of(["▁" + w for w in block], last))
            out, scale = np.zeros((len(block), languages)), np.zeros((len(block), languages))
            alpha = np.zeros((last + 1, len(block), languages))
            alpha[0] = 1.0
            for end in range(1, last + 1):
                first = int(np.searchsorted(n, end))
                for start in range(max(0, end - limit), end):
                    got = ids[end - start - 1][first:, start]
                    hit = np.flatnonzero(got != none)
                    if len(hit):
                        alpha[end, first + hit] += alpha[start, first + hit] * probability[got[hit]]
                done = slice(first, int(np.searchsorted(n, end, "right")))
                out[done] = np.log(np.maximum(alpha[end, done], 1e-300)) + scale[done]
                if end % 16 == 0:  # keeps long words from underflowing
                    low = max(0, end - limit)
                    top = np.maximum(alpha[low : end + 1].max(axis=0), 1e-300)
                    alpha[low : end + 1] /= top
                    scale += np.log(top)
            return out

        def forward_long(word: str, stretch: int = 1 << 15) -> np.ndarray:
            """Of a single long run of letters, a stretch at a time."""
            codes, scale = codes_of(["▁" + word], len(word) + 1), np.zeros(languages)
            alpha = np.zeros((limit + 1, languages))  # of the place k at k modulo its size
            alpha[0] = 1.0
            for begin in range(0, codes.shape[1], stretch):
                low = max(0, begin - limit + 1)
                part = codes[:, low : begin + stretch]
                at_end = np.full((part.shape[1] + 1, limit), none, np.int32)
                for size, ids in enumerate(pieces_in(part), 1):
                    at_end[size:, size - 1] = ids[0]
                for end in range(begin + 1, low + part.shape[1] + 1):
                    row = at_end[end - low]
                    sizes = np.flatnonzero(row != none)
                    alpha[end % (limit + 1)] = (alpha[(end - 1 - sizes) % (limit + 1)] * probability[row[sizes]]).sum(axis=0)
                    if end % 16 == 0:
                        top = np.maximum(alpha.max(axis=0), 1e-300)
                        alpha /= top
                        scale += np.log(top)
            return np.log(np.maximum(alpha[codes.shape[1] % (limit + 1)], 1e-300)) + scale

        def score(words: list[str]) -> np.ndarray:
            out = np.zeros((len(words), languages))
            order = sorted(range(len(words)), key=lambda k: len(words[k]))
            at = 0
            while at < len(order):
                size = len(words[order[at]])
                if size > 200:
                    out[order[at]] = forward_long(words[order[at]])
                    at += 1
                    continue
                stop = at + 1
                longest = min(200, size + 4 + size // 3)
                most = max(1, (4 << 20) // ((longest + 2) * max(languages, limit)))
                while stop < len(order) and stop - at < most and len(words[order[stop]]) <= longest:
                    stop += 1
                out[order[at:stop]] = forward([words[k] for k in order[at:stop]])
                at = stop
            return out

        return score

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.scorer()(words)


def codes_of(words: list[str], width: int) -> np.ndarray:
    """The words' code points; zeros behind them."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width).astype(np.int64)


def spans(codes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For each length up to ``most``, a hash of the code points of that many places from each place on."""
    h = np.zeros_like(codes)
    for size in range(1, most + 1):
        h = h[:, : codes.shape[1] - size + 1] * 0x5851F42D4C957F2D + codes[:, size - 1 :]
        yield h


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 20_000, smoothing: float = 0.2, pieces_path: str | None = None, seed: int = 11) -> LanguageModel:
    """Piece probabilities per language from at most about ``sample_rows`` labelled rows, chosen by a seeded hash.

    Rows with a null text or language teach nothing. Piece counts are summed on the executors; what reaches the driver
    is bounded by languages times vocabulary. Without any labelled row the model has the one language ``und``.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    picked = sampled(known, "id", bounded_fraction(known.count(), sample_rows), seed).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, rows, held = load_pieces(pieces_path), {}, Counter(), 0

        def flush() -> pa.RecordBatch:
            out: dict[tuple[str, int], int] = {}
            for lang, counter in words.items():
                keys = list(counter)
                for ids, n in zip(model.encode(keys, num_threads=1), counter.values(), strict=True):
                    for i in ids:
                        out[lang, i] = out.get((lang, i), 0) + n
            for lang, n in rows.items():
                out[lang, -1] = n
            words.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["lang", "piece", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                rows[lang] += 1
                counter = words.setdefault(lang, Counter())
                for chunk, n in Counter(text.as_py().split()).items():
                    for w in letters_of(chunk):
                        counter[w] += n
                        held += len(w) + 50
                if held > 16 << 20:
                    yield flush()
                    held = 0
        yield flush()

    counts = map_in_python(picked, count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counts}) or [UNDETERMINED]
    model = load_pieces(pieces_path)
    size = model.get_piece_size()
    table, prior = np.full((size, len(languages)), smoothing), np.ones(len(languages))
    column = {lang: k for k, lang in enumerate(languages)}
    for r in counts:
        if r.piece < 0:
            prior[column[r.lang]] += r.n
        else:
            table[r.piece, column[r.lang]] += r.n
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    others = table.sum(axis=0) - table[usable].sum(axis=0)
    table = np.vstack([table[usable], np.full((1, len(languages)), 1.0)])
    table[-1] += others / 1000
    return LanguageModel(languages, {model.id_to_piece(i): k for k, i in enumerate(usable)}, np.log(table / table.sum(axis=0)), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None, temper: float = 0.25, cache_bytes: int = 24 << 20) -> DataFrame:
    """Appends the likeliest language of each whole text and its probability.

    A null text, or one without a letter, gets ``und`` and score 0. ``temper`` scales the evidence of a text before
    it is normalised, since words aren't independent. Ties go to the first language by name. ``fit_out`` names a
    column for the mean log probability of a letter in that language, null without a letter: it is low in a text of no
    language of the model. All columns of ``docs`` stay, except that one with the name of an output is replaced. A
    task keeps the scores of the chunks it met, ``cache_bytes`` at most and those of one part of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outputs = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())] + ([T.StructField(fit_out, T.DoubleType())] if fit_out else [])

    def make():
        m: LanguageModel = shared.value
        width, word_scores = len(m.languages), m.scorer()
        most = max(1000, cache_bytes // (8 * (width + 1) + 160))
        row_of: dict[bytes, int] = {}
        table = np.zeros((0, width + 1))  # by chunk: log probabilities of its words, and its letters

        def learn(chunks: list[bytes]) -> np.ndarray:
            words: dict[str, int] = {}
            owners, which, out = [], [], np.zeros((len(chunks), width + 1))
            for k, c in enumerate(chunks):
                for w in letters_of(c.decode("utf-8", "replace")):
                    owners.append(k)
                    which.append(words.setdefault(w, len(words)))
            if words:
                scores = np.hstack([word_scores(list(words)), np.array([[len(w)] for w in words])])
                np.add.at(out, owners, scores[which])
            return out

        def run(texts: pa.Array) -> list:
            nonlocal table
            total = np.zeros((len(texts), width + 1))
            for rows, parts in text_parts(texts):
                offsets, codes, distinct = chunks_of(parts)
                distinct = distinct.to_pylist()
                if len(row_of) > most:
                    again = [c for c in distinct if c in row_of]
                    table = table[[row_of[c] for c in again]]
                    row_of.clear()
                    row_of.update(zip(again, range(len(again)), strict=True))
                new = [c for c in distinct if c not in row_of]
                if new:
                    row_of.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate((table, learn(new)))
                place = np.fromiter(map(row_of.__getitem__, distinct), np.int64, len(distinct))
                np.add.at(total, rows, np.add.reduceat(table[place[codes]], offsets[:-1]))
            letters = total[:, -1]
            evidence = total[:, :-1] * temper + m.prior
            p = np.exp(evidence - evidence.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            langs = [m.languages[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)]
            rows = np.arange(len(best))
            out = [langs, np.where(letters > 0, p[rows, best] / p.sum(axis=1), 0.0)]
            if fit_out:
                out.append([t / n if n else None for t, n in zip(total[rows, best].tolist(), letters.tolist(), strict=True)])
            return out

        return run

    return with_columns_from_python(docs, [text_col], outputs, make)
