"""Benchmark decontamination by latent semantic retrieval.

1. Texts become arrays of term numbers, once, in a written table. Terms are the words of the benchmark (lower case, edge
   punctuation cut); all other words are 0, since they can match nothing.
2. TF-IDF over passages of the whole corpus: document frequencies are summed in Spark.
3. A randomised SVD of the passages x terms matrix A, distributed by rows: Z = A'(A W) for a random W, an orthonormal
   basis Q of Z, and A'(A Q) give the leading right singular vectors (Rayleigh-Ritz). Tasks send sums of terms x rank.
4. Windows of every text and the benchmark items are projected on these vectors; pairs with a high cosine are candidates.
5. A candidate is verified by the longest common subsequence of its words with the item's, and by an answer check: a
   paraphrase must hold the item's last sentence.

Items of fewer than MIN_WORDS words have too few terms for that; they are found word for word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm.common import Shield, checkpoint, hash_words, written

RANK, OVERSAMPLE, RANDOM_SEED = 96, 8, 7
#: Words of a passage of the matrix; words of a block, of which windows are made.
PASSAGE, BLOCK = 64, 8
#: Terms in more than this share of passages have weight 0 in vectors, unless they are of the rarer half of an item's
#: terms; all terms count in verification.
MAX_DF = 0.02
MIN_COSINE = 0.45
#: Verbatim: this share of the item's words in order. Paraphrase: the lower share, and that share of the answer's.
LCS_VERBATIM, LCS_PARAPHRASE, ANSWER = 0.8, 0.55, 0.75
#: Items longer than PIECE words are searched in equal pieces. Those with fewer than MIN_WORDS are found where their words
#: stand in a row, and with fewer than MIN_RUN only in texts that consist of them.
PIECE, MIN_WORDS, MIN_RUN = 64, 5, 3
#: (item words up to, blocks of a window, blocks from a window to the next): a window holds any such item whole.
SIZES = ((16, 3, 1), (24, 4, 1), (40, 6, 1), (PIECE, 10, 2))
#: A benchmark is searched in blocks of this many items, each with a vocabulary and vectors of its own: what is broadcast
#: (terms x rank, and the items) is bounded by the block, and a larger benchmark costs more passes over the texts.
ITEMS = 20_000
#: Words handled at once in a task, a multiple of PASSAGE and of the blocks from a window to the next; longer texts are
#: cut, and for windows the pieces go on with the longest window's words.
CHUNK = 102_400
#: Windows and pieces of items whose cosines are in memory at once.
WINDOWS, ROWS = 16_384, 512
#: ASCII characters that part words beside white space.
_MARKS = ".,;:!?\"'()[]{}|*#$%&<>-_/\\"
_PARTING = re.compile(r"[\x20\x09-\x0D" + re.escape(_MARKS) + "]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str | None) -> list[str]:
    """Lower-case words, parted by white space and punctuation."""
    return [w for w in _PARTING.split((text or "").lower()) if w]


@dataclass
class Piece:
    item_id: object
    terms: np.ndarray
    #: The part of the item's last sentence that the piece holds; without any the piece is found verbatim only.
    answer: np.ndarray
    group: int


@dataclass
class Queries:
    """A block of the benchmark as vocabulary, pieces of items, and short items by their terms."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    pieces: list[Piece] = field(default_factory=list)
    short: dict[tuple[int, ...], list] = field(default_factory=dict)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if len(self.vocabulary) < 1 << 16 else "<u4")


def queries_of(rows: list[tuple[object, str | None]]) -> Queries:
    q = Queries()
    for item, text in rows:
        words = terms_of(text)
        if not words:
            continue
        ids = np.array([q.vocabulary.setdefault(w, len(q.vocabulary) + 1) for w in words], np.int64)
        if len(words) < MIN_WORDS:
            q.short.setdefault(tuple(ids.tolist()), []).append(item)
            continue
        sentences = [s for s in _SENTENCE.split((text or "").strip()) if terms_of(s)]
        n_answer = len(terms_of(sentences[-1])) if len(sentences) > 1 else math.ceil(len(words) / 4)
        n, at = math.ceil(len(words) / PIECE), len(ids) - n_answer
        for k in range(n):
            low, high = len(ids) * k // n, len(ids) * (k + 1) // n
            q.pieces.append(Piece(item, ids[low:high], ids[max(low, at) : high], next(i for i, s in enumerate(SIZES) if high - low <= s[0])))
    return q


class _Numbers:
    """Word hashes -> term numbers, 0 for other words: a table addressed by leading bits, and hashes to compare with."""

    def __init__(self, vocabulary: dict[str, int]):
        self.hashes = np.zeros(len(vocabulary) + 1, np.uint64)
        self.hashes[1:] = np.concatenate(hash_words([" ".join(vocabulary)], _MARKS))
        self.bits = max(16, 4 + len(vocabulary).bit_length())
        self.order = np.argsort(self.hashes[1:]).astype(np.int32) + 1
        self.first = np.searchsorted(self.hashes[self.order], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.depth = int(np.bincount((self.hashes[1:] >> np.uint64(64 - self.bits)).astype(np.intp)).max()) if vocabulary else 0

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.intp)]
        for k in range(self.depth):
            n = self.order[np.minimum(at + k, len(self.order) - 1)]
            np.copyto(out, n, where=self.hashes[n] == h)
        return out


def numbered(docs: DataFrame, q: Queries, key: str, text: str) -> DataFrame:
    """(_key, terms binary): the term numbers of each whole text, packed."""
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("terms", T.BinaryType())])
    shared, dtype = docs.sparkSession.sparkContext.broadcast(q.vocabulary), q.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(shared.value)
        for batch in batches:
            hashes = hash_words(batch.column(1).to_pylist(), _MARKS)
            terms = numbers.of(np.concatenate(hashes)).astype(dtype) if hashes else np.zeros(0, dtype)
            ends = np.cumsum([len(h) for h in hashes])
            blobs = [t.tobytes() for t in np.split(terms, ends[:-1])] if hashes else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["_key", "terms"])

    return docs.select(key, text).mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch], dtype: np.dtype, more: int = 0) -> Iterator[tuple[list, np.ndarray, np.ndarray, int, bool]]:
    """Keys, term numbers of several texts on end, where each text begins (and the last ends), where in its text the
    first begins, and whether its text goes on. A text of over CHUNK words comes in pieces by itself, each with ``more``
    words of the next one."""
    keys, arrays, size = [], [], 0

    def whole() -> tuple[list, np.ndarray, np.ndarray, int, bool]:
        return keys, np.concatenate(arrays), np.cumsum([0, *map(len, arrays)]), 0, False

    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            a = np.frombuffer(blob.as_buffer(), dtype)
            if not len(a):
                continue
            if arrays and size + len(a) > CHUNK:
                yield whole()
                keys, arrays, size = [], [], 0
            if len(a) > CHUNK:
                for at in range(0, len(a), CHUNK):
                    piece = a[at : at + CHUNK + more].astype(np.int32)
                    yield [key], piece, np.array([0, len(piece)]), at, at + CHUNK < len(a)
                continue
            keys.append(key)
            arrays.append(a.astype(np.int32))
            size += len(a)
    if arrays:
        yield whole()


def _passages(terms: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """For each word the number of its passage; passages do not reach over texts."""
    lengths = np.diff(bounds)
    of_text = -(-lengths // words)
    first = np.cumsum(of_text) - of_text
    inside = np.arange(len(terms)) - np.repeat(bounds[:-1], lengths)
    return np.repeat(first, lengths) + inside // words


def document_frequencies(numbers: DataFrame, q: Queries) -> tuple[np.ndarray, int]:
    """Passages with each term, and the number of passages (in place 0)."""
    size, dtype = len(q.vocabulary) + 1, q.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for _, terms, bounds, _, _ in _chunks(batches, dtype):
            passage = _passages(terms, bounds, PASSAGE)
            df[0] += passage[-1] + 1
            hit = terms > 0
            df += np.bincount((np.unique(passage[hit] * size + terms[hit]) % size).astype(np.intp), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    got = numbers.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size, np.int64)
    df[got["term"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    total, df[0] = int(df[0]), 0
    return df, total


def _gram(numbers: DataFrame, weights: np.ndarray, basis: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """A'(A basis), A being the TF-IDF matrix of all passages: each task sums up its rows' share, Spark adds the shares."""
    spark = numbers.sparkSession
    size, rank = basis.shape
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), basis.astype(np.float32)))
    rows = 256  # terms of a block of the sum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        weighted = weights[:, None] * basis
        total, used = np.zeros((size, rank)), False
        for _, terms, bounds, _, _ in _chunks(batches, dtype):
            passage = _passages(terms, bounds, PASSAGE)
            hit = weights[terms] > 0
            term, passage = terms[hit], passage[hit]
            if not len(term):
                continue
            used = True
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            dense = np.cumsum(np.concatenate([[0], (passage[1:] != passage[:-1]).astype(np.intp)]))
            projected = np.add.reduceat(weighted[term], starts)
            order = np.argsort(term.astype(dtype), kind="stable")
            term = term[order]
            firsts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            total[term[firsts]] += np.add.reduceat(projected[dense[order]], firsts)
        total *= weights[:, None]
        if used:
            blocks = list(range(0, size, rows))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([total[b : b + rows].tobytes() for b in blocks], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["block", "sums"])
                    now, held = block, np.zeros(len(sums) // 8)
                held += np.frombuffer(sums)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["block", "sums"])

    schema = "block long, sums binary"
    shares = numbers.mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    out = np.zeros((size, rank))
    for row in shares.collect():  # terms x rank, whatever the corpus
        out[row["block"] : row["block"] + rows] = np.frombuffer(row["sums"]).reshape(-1, rank)
    return out


def latent_vectors(numbers: DataFrame, q: Queries, rank: int = RANK) -> np.ndarray:
    """(terms + 1) x rank float32: each term's weight times its row of the right singular vectors; row 0 is zero."""
    df, total = document_frequencies(numbers, q)
    kept = df <= MAX_DF * total
    for p in q.pieces:  # each piece keeps the rarer half of its terms, whatever their frequency
        own = np.unique(p.terms)
        kept[own[np.argsort(df[own], kind="stable")][: math.ceil(len(own) / 2)]] = True
    weights = np.where(kept & (df > 0), np.log1p(total / np.maximum(df, 1)), 0.0)
    wide = min(rank + OVERSAMPLE, max(1, int((weights > 0).sum())))
    start = np.random.default_rng(RANDOM_SEED).standard_normal((len(weights), wide))
    basis = np.linalg.qr(_gram(numbers, weights, start, q.dtype))[0]
    ritz = basis.T @ _gram(numbers, weights, basis, q.dtype)
    values, vectors = np.linalg.eigh((ritz + ritz.T) / 2)
    keep = np.argsort(-values)[: min(rank, wide)]
    return (weights[:, None] * (basis @ vectors[:, keep])).astype(np.float32)


def lcs(a: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a and the sequence of n terms whose bit masks are given."""
    v = full = (1 << n) - 1
    for t in a.tolist():
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(terms: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


MATCH = [("item_id", None), ("start_word", T.LongType()), ("window_words", T.IntegerType()), ("cosine", T.DoubleType()), ("lcs_share", T.DoubleType()), ("answer_share", T.DoubleType())]


def _search(numbers: DataFrame, q: Queries, vectors: np.ndarray, key_type: T.DataType, item_type: T.DataType, min_cosine: float) -> DataFrame:
    schema = T.StructType([T.StructField("_key", key_type), *(T.StructField(n, t or item_type) for n, t in MATCH)])
    groups = []
    for g, (_, blocks, step) in enumerate(SIZES):
        own = [i for i, p in enumerate(q.pieces) if p.group == g]
        for at in range(0, len(own), ROWS):
            some = own[at : at + ROWS]
            v = np.stack([vectors[q.pieces[i].terms].sum(axis=0) for i in some])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            groups.append((blocks, step, some, v.astype(np.float32)))
    shared = numbers.sparkSession.sparkContext.broadcast((vectors, groups, q.pieces, q.short))
    dtype, longest = q.dtype, BLOCK * max(s[1] for s in SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, groups, pieces, short = shared.value
        has_vector = (vectors != 0).any(axis=1)
        masks = [(_masks(p.terms), _masks(p.answer)) for p in pieces]
        holds = np.zeros(len(vectors), bool)  # the terms of one piece at a time
        rows: dict[tuple, tuple] = {}
        for keys, terms, bounds, base, goes_on in _chunks(batches, dtype, longest):
            _find_short(short, terms, bounds, base, goes_on, rows)
            lengths = np.diff(bounds)
            n_blocks = -(-lengths // BLOCK)
            starts = np.repeat(bounds[:-1], n_blocks) + BLOCK * (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
            text = np.repeat(np.arange(len(keys)), n_blocks)
            ends = np.append(starts[1:], len(terms))
            sums = np.zeros((len(starts) + 1, vectors.shape[1]))
            hit = np.flatnonzero(has_vector[terms])
            if len(hit):
                block = np.searchsorted(starts, hit, side="right") - 1
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                sums[block[first] + 1] = np.add.reduceat(vectors[terms[hit]], first)
            np.cumsum(sums, axis=0, out=sums)  # in doubles: what a window has must not depend on what stands before it
            number = np.arange(len(starts))
            inside = number - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
            block_end = np.cumsum(n_blocks)[text]  # one past the text's last block
            for blocks, step, own, wanted in groups:
                last = np.minimum(number + blocks, block_end)
                use = (inside % step == 0) & ((inside == 0) | (last - number > blocks - step))
                if goes_on:  # windows that begin in the next piece are that one's
                    use &= inside * BLOCK < CHUNK
                use = np.flatnonzero(use)
                for at in range(0, len(use), WINDOWS):
                    w = use[at : at + WINDOWS]
                    v = (sums[last[w]] - sums[w]).astype(np.float32)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    cosine = v @ wanted.T
                    for a, b in _bounded(cosine, min_cosine, w, last, starts, ends, terms, holds, pieces, own):
                        piece, (whole, answer) = pieces[own[b]], masks[own[b]]
                        window = terms[starts[w[a]] : ends[last[w[a]] - 1]]
                        share = lcs(window, whole, len(piece.terms)) / len(piece.terms)
                        if share < LCS_PARAPHRASE:
                            continue
                        told = lcs(window, answer, len(piece.answer)) / len(piece.answer) if len(piece.answer) else 0.0
                        if share >= LCS_VERBATIM or told >= ANSWER:
                            t = int(text[w[a]])
                            _better(rows, (t, piece.item_id), (share, float(cosine[a, b]), -int(starts[w[a]] - bounds[t] + base), len(window), told))
            if rows and not goes_on:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[t] for t, _ in rows]), pa.array([i for _, i in rows]), pa.array([-x[2] for x in rows.values()], pa.int64()), pa.array([x[3] for x in rows.values()], pa.int32()), *(pa.array([x[k] for x in rows.values()], pa.float64()) for k in (1, 0, 4))],
                    ["_key", *(n for n, _ in MATCH)],
                )
            if not goes_on:
                rows = {}

    return numbers.mapInArrow(run, schema)


def _better(rows: dict[tuple, tuple], name: tuple, found: tuple) -> None:
    """Keep the best window: the largest share, then cosine, then the one that begins first."""
    if name not in rows or rows[name] < found:
        rows[name] = found


def _find_short(short: dict[tuple[int, ...], list], terms: np.ndarray, bounds: np.ndarray, base: int, goes_on: bool, rows: dict[tuple, tuple]) -> None:
    """Short items, word for word: their first terms' places are looked up, the rest compared."""
    if not short:
        return
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    for wanted, items in short.items():
        m = len(wanted)
        low, high = np.searchsorted(ranked, [wanted[0], wanted[0] + 1])
        at = order[low:high]
        at = at[at + m <= len(terms)]
        for k in range(1, m):
            at = at[terms[at + k] == wanted[k]]
        t = np.searchsorted(bounds, at, side="right") - 1
        own = at + m <= bounds[t + 1]
        if m < MIN_RUN:
            own &= (bounds[t + 1] - bounds[t] == m) & (base == 0) & (not goes_on)
        for place, number in zip(at[own].tolist(), t[own].tolist()):
            for item in items:
                _better(rows, (number, item), (1.0, 1.0, -(place - int(bounds[number]) + base), m, 1.0))


def _bounded(cosine, least, w, last, starts, ends, terms, holds, pieces, own) -> Iterator[tuple[int, int]]:
    """Candidates by cosine whose window holds enough of the piece's words for any subsequence to be long enough."""
    a, b = np.nonzero(cosine >= least)
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for low, high in zip(cuts, [*cuts[1:], len(b)]):
        piece = pieces[own[b[low]]]
        holds[piece.terms] = True
        need = math.ceil(LCS_PARAPHRASE * len(piece.terms))
        for k in range(low, high, 20_000):
            x = a[k : min(high, k + 20_000)]
            begin, size = starts[w[x]], ends[last[w[x]] - 1] - starts[w[x]]
            at = begin[:, None] + np.arange(size.max())[None, :]
            inside = np.arange(size.max())[None, :] < size[:, None]
            common = (holds[terms[np.minimum(at, len(terms) - 1)]] & inside).sum(axis=1)
            for i in np.flatnonzero(common >= need):
                yield int(x[i]), int(b[low])
        holds[piece.terms] = False


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = RANK, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each document and benchmark item found in it: key, item_id, start_word and window_words (the best
    window, in terms: the largest lcs_share, then cosine, then the first), cosine, lcs_share and answer_share.

    Null and empty texts and items match nothing; equal texts have equal matches; rows with equal (or null) keys give
    rows each; items with equal ids have one row in a document, that of the best; without items, or without texts, there
    are no rows. Items of over PIECE words are found by any of their pieces. Texts of any length are searched whole, in
    overlapping pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t or benchmark.schema[item].dataType) for n, t in MATCH)])
    out, block = None, []

    def searched() -> DataFrame:
        q = queries_of(block)
        if not q.vocabulary:
            return spark.createDataFrame([], schema)
        numbers = written(numbered(docs, q, key, text), "terms")
        vectors = latent_vectors(numbers, q, rank) if q.pieces else np.zeros((len(q.vocabulary) + 1, 1), np.float32)
        return _search(numbers, q, vectors, docs.schema[key].dataType, benchmark.schema[item].dataType, min_cosine).withColumnRenamed("_key", key)

    for row in benchmark.select(item, item_text).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS:
            out = searched() if out is None else out.unionByName(searched())
            block = []
    if block or out is None:
        out = searched() if out is None else out.unionByName(searched())
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those in which a benchmark item was found. Rows are judged by their texts (a hash of 64 bits), so keys
    may be null or stand more than once."""
    shield = Shield(docs)
    own = shield.df.withColumn("_own", F.xxhash64(shield(text)))
    bad = checkpoint(leaks(own.select("_own", F.col(shield(text)).alias("_text")), benchmark, "_own", "_text").select(F.col("_own").alias("_leak")).distinct())
    return shield.restored(own.join(bad, F.col("_own") == F.col("_leak"), "left_anti"))


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs.select("doc_id", "text"), benchmark)
