"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in the tasks and sums them by language and bucket in Spark; what reaches the driver is a
matrix of languages x buckets, whose size depends on parameters only. It is broadcast, and whole texts are scored in
numpy: the n-gram buckets of a batch of texts are gathered from the matrix and summed text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm.common import Shield

ORDERS = (1, 2, 3)
#: Hash bits of the buckets: as many as keep the matrix of buckets x languages within 2**CELL_BITS values (64 MB of
#: float32), from MIN_BITS to BITS. So up to 512 languages have all buckets, more have fewer.
BITS, MIN_BITS, CELL_BITS = 15, 10, 24
#: A bounded sample of labelled rows is enough for counts. Each language has an equal quota of SAMPLE_ROWS; what small
#: ones leave goes to the larger ones.
SAMPLE_ROWS = 20_000
UNKNOWN = "und"
#: Code points taken at once: longer texts are counted and scored piece by piece, so beside the text itself the memory
#: of a task has a bound.
CHUNK = 250_000
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_buckets(points: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each order n the buckets of the n-grams beginning at each of the first len(points) - n + 1 code points."""
    for n in orders:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _MIX[k % 3]
            h ^= h >> np.uint32(15)
        yield (h >> np.uint32(32 - bits)).astype(np.intp)


def code_points(text: str) -> np.ndarray:
    """Lower-cased text as code points, a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces_of(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The code points of a text piece by piece, and how many places of each begin n-grams of its own: a piece goes on
    with the first code points of the next one, so that together they have the n-grams of the whole (but for a Greek sigma
    at a cut, whose lower case depends on what follows)."""
    for at in range(0, max(1, len(text)), CHUNK):
        own, more = text[at : at + CHUNK].lower(), text[at + CHUNK : at + CHUNK + max(ORDERS) - 1].lower()[: max(ORDERS) - 1]
        own, more = " " * (at == 0) + own, more if at + CHUNK < len(text) else " "
        points = np.frombuffer((own + more).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield points, len(points) if at + CHUNK >= len(text) else len(points) - len(more)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learns(key: str) -> Column:
    """Whether a row may be learnt from: crc32 of its key as text, mod 4, is not 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def bits_for(n_langs: int) -> int:
    return max(MIN_BITS, min(BITS, CELL_BITS - max(0, n_langs - 1).bit_length()))


def _counts(bits: int):
    """Texts with lang -> (lang, bucket, n) summed up in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in batches:
            for lang, text in zip(frame["lang"], frame["text"]):
                own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                for points, begin in pieces_of(text):
                    for buckets in ngram_buckets(points, bits=bits):
                        own += np.bincount(buckets[:begin], minlength=1 << bits)
            if len(sums) > 256:  # many languages: a task holds some of them at a time
                yield from _counted(sums)
                sums = {}
        yield from _counted(sums)

    return run


def _counted(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, own in sums.items():
        hit = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": hit.astype(np.int32), "n": own[hit]})


def _packed(bits: int):
    """(lang, bucket, n) sorted by lang -> (lang, counts of all buckets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, np.zeros(1 << bits, np.int64)
        for frame in batches:
            for lang, part in frame.groupby("lang", sort=False):
                if lang != now and now is not None:
                    yield pd.DataFrame({"lang": [now], "counts": [own.tobytes()]})
                    own[:] = 0
                now = lang
                own[part["bucket"].to_numpy()] += part["n"].to_numpy()
        if now is not None:
            yield pd.DataFrame({"lang": [now], "counts": [own.tobytes()]})

    return run


def fit(labelled: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log-probability matrix, buckets x languages, of rows with key, lang and text.

    Rows with a null lang or text are not used. If there are more than ``sample_rows`` rows, those of a language are used
    whose key's hash falls into the share quota / its rows, each with its whole text. The quota is such that about
    ``sample_rows`` rows are used; languages with fewer rows than that are used whole, so all are learnt at any size. Rows with equal keys are used or
    left together. Without any such row no language is learnt.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1))).limit((1 << CELL_BITS - MIN_BITS) + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > 1 << CELL_BITS - MIN_BITS:
        raise ValueError(f"lang has more than {1 << CELL_BITS - MIN_BITS} values; it holds no languages")
    bits = bits_for(len(langs))
    if sum(sizes.values()) > sample_rows:
        quota, left = 0.0, float(sample_rows)
        for k, n in enumerate(sorted(sizes.values())):
            quota = left / (len(sizes) - k)
            if n > quota:
                break
            left -= n
        u = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), 34)  # 0 .. 2**30 - 1
        shares = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, int(min(1.0, quota / n) * 2**30))])
        rows = rows.filter(u < shares[F.col("lang")])
    counts = rows.select("lang", "text").mapInPandas(_counts(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.repartition("lang").sortWithinPartitions("lang").mapInPandas(_packed(bits), "lang string, counts binary")
    matrix = np.full((1 << bits, len(langs)), np.float32(0.5))
    place = {x: i for i, x in enumerate(langs)}
    for row in packed.toLocalIterator():  # a row for each language, its size a parameter's
        matrix[:, place[row["lang"]]] += np.frombuffer(row["counts"], np.int64)
    for j in range(len(langs)):
        own = matrix[:, j].astype(np.float64)
        matrix[:, j] = np.log(own) - np.log(own.sum())
    return langs, matrix


def _log_likelihoods(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Texts x languages: the sum over each whole text's n-grams. A single text may be of any length."""
    out = np.zeros((len(texts), matrix.shape[1]))
    bits = (len(matrix) - 1).bit_length()
    columns = [np.ascontiguousarray(matrix[:, j]) for j in range(matrix.shape[1])]
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        for points, begin in pieces_of(texts[0]):
            for buckets in ngram_buckets(points, bits=bits):
                for j, column in enumerate(columns):
                    out[0, j] += column[buckets[:begin]].sum(dtype=np.float64)
        return out
    points = [code_points(t) for t in texts]
    flat = np.concatenate(points)
    ends = np.cumsum([len(p) for p in points])
    for n, buckets in zip(ORDERS, ngram_buckets(flat, bits=bits)):
        # n-grams that reach into the next text are no n-grams of either
        last = (ends[:-1, None] - np.arange(1, n)[None, :]).ravel() if n > 1 else np.zeros(0, np.intp)
        starts = np.concatenate([[0], ends[:-1]])
        for j, column in enumerate(columns):
            got = column[buckets].astype(np.float64)
            got[last[last < len(got)]] = 0
            out[:, j] += np.add.reduceat(np.append(got, np.zeros(n)), starts)
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` (a learnt language, or ``und`` if the text is null or has no letter, or if nothing was
    learnt) and ``score`` (the posterior of that language under equal priors, its evidence averaged down to one in
    eight n-grams, since overlapping n-grams repeat each other; 0 for ``und``). Of languages that are equally likely the
    first in order of their names is taken. Texts of any length are scored whole, in pieces; equal texts have equal
    predictions; an empty table stays empty. Columns of these names are replaced."""
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def score(column: pd.Series) -> pd.DataFrame:
        matrix, names, best = shared.value, [UNKNOWN] * len(column), np.zeros(len(column))
        texts = column.tolist()
        rows = [i for i, t in enumerate(texts) if langs and has_letter(t)]
        at = 0
        while at < len(rows):
            upto, size = at, 0
            while upto < len(rows) and (upto == at or size + len(texts[rows[upto]]) < CHUNK):
                size += len(texts[rows[upto]])
                upto += 1
            logs = _log_likelihoods([texts[i] for i in rows[at:upto]], matrix) / 8
            logs -= logs.max(axis=1, keepdims=True)
            p = np.exp(logs)
            p /= p.sum(axis=1, keepdims=True)
            for i, k, v in zip(rows[at:upto], p.argmax(axis=1), p.max(axis=1)):
                names[i], best[i] = langs[k], v
            at = upto
        return pd.DataFrame({"lang_pred": names, "score": best})

    shield = Shield(docs)
    return shield.restored(shield.df.withColumn("_p", score(F.col(shield(text)))), lang_pred="_p.lang_pred", score="_p.score")


def op6(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by a model fitted to those that are not held out."""
    slim = docs.select("doc_id", "lang", "text")
    model = fit(slim.filter(learns("doc_id")))
    return predict(slim.select("doc_id", "text", (~learns("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The filter of the pipeline: documents whose language is known with at least ``min_score``; columns of docs."""
    model = fit(docs.select("doc_id", "lang", "text").filter(learns("doc_id")))
    shield = Shield(docs)
    out = predict(shield.df, model, shield("text")).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return shield.restored(out)
