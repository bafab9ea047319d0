"""Periodic runs of words by repeated k-gram masking and Main-Lorentz.

A run of period q and length >= max(MIN_WORDS, MIN_TIMES * q) overlaps itself, shifted by q, in length - q words, so each
of its words is in a k-gram that stands twice in the document, for every k up to the least such overlap. Words outside
repeated k-grams are masked; between them lie few and short segments. Only these are searched: halves of a dyadic tree
over the segments of many documents at once, at each centre all periods a run across it can have, extended both ways.
Words are named by numbers, and so are their blocks of 1, 2, 4, ... words (equal names: equal blocks, no hashing), so a
comparison of two stretches takes two look-ups, an extension one for each power of two, and numpy does all of a level at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm.common import CRC_TABLE_SQL, WORD, Shield, crc32_sql

#: Fixed by the definition of a run: its least length, and how often its period must fit into it.
MIN_WORDS, MIN_TIMES = 6, 4
#: The least overlap of a run with itself, shifted by its period: the k of the masking.
K = min(max(MIN_WORDS, MIN_TIMES * q) - q for q in range(1, MIN_WORDS + 1))
#: Words of short documents that are searched at once.
AT_ONCE = 200_000

_WORD = re.compile(WORD)
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("_runs", T.ArrayType(_RUN)), T.StructField("_n", T.LongType()), T.StructField("_kept", T.StringType())])


def _paired(names: np.ndarray, step: int) -> np.ndarray:
    """Names of blocks from the names of two blocks, of which one begins ``step`` words after the other."""
    return np.unique(names[: len(names) - step] * (int(names.max()) + 1) + names[step:], return_inverse=True)[1].astype(np.int64)


def repeated(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Which words lie in a k-gram that stands twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) <= k:
        return out
    names, size = ids, 1
    while size < k:
        step = min(size, k - size)
        names, size = _paired(names, step), size + step
    hit = np.bincount(names)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[k : k + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words, as long as one of them stands twice."""
    names = np.unique(x, return_inverse=True)[1].astype(np.int64)
    out = []
    while len(names) and int(names.max()) + 1 < len(names):
        out.append(names.astype(np.int32))
        step = 1 << (len(out) - 1)
        if step >= len(names):
            break
        names = _paired(names, step)
    return out


def _extended(blocks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words after (before) i equal those after (before) j, for i < j, pair by pair."""
    total = np.zeros(len(i), np.int64)
    for b in range(len(blocks) - 1, -1, -1):
        names, size = blocks[b], 1 << b
        low, high = (i - total - size, j - total - size) if back else (i + total, j + total)
        fits = np.flatnonzero((low >= 0) & (high < len(names)))
        same = fits[names[low[fits]] == names[high[fits]]]
        total[same] += size
    return total


def _across(x_segment: np.ndarray, lengths: np.ndarray, blocks: list[np.ndarray], level: int) -> np.ndarray:
    """(start, end, period) rows of the runs across the centres of one level of the tree."""
    n, longest = len(x_segment), 1 << len(blocks)
    centres = np.arange(1 << level, n, 2 << level)
    most = np.minimum(np.minimum(1 << (level - 1), longest - 1), lengths[x_segment[centres]] // MIN_TIMES)
    c = np.repeat(centres, most)
    q = np.arange(len(c)) - np.repeat(np.cumsum(most) - most, most) + 1
    power = np.frexp(q.astype(float))[1] - 1
    found = []
    for first in (c, c - 2 * q):  # two periods after the centre are alike, or two before it
        ok = np.zeros(len(c), bool)
        for b in range(len(blocks)):
            at = np.flatnonzero((power == b) & (first >= 0) & (first + 2 * q <= n))
            names, i, p = blocks[b], first[at], q[at]
            at = at[names[i] == names[i + p]]
            i, p = first[at] + q[at] - (1 << b), q[at]
            ok[at[names[i] == names[i + p]]] = True
        i, p = first[ok], q[ok]
        start = i - _extended(blocks, i, i + p, True)
        end = i + p + _extended(blocks, i, i + p, False)
        long = end - start >= np.maximum(MIN_WORDS, MIN_TIMES * p)
        found.append(np.stack([start, end, p], 1)[long])
    return np.concatenate(found)


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) rows, by start and period, of all runs of a sequence of non-negative numbers.

    Exact, in O(n log n) steps but for sorting. Documents may be searched together if they have no number in common.
    """
    none = np.zeros((0, 3), np.int64)
    mask = repeated(ids)
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= MIN_WORDS
    first, lengths = first[long], (last - first)[long]
    if not len(first):
        return none
    # the segments, each with a stop of its own behind it, one after the other
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    segment = np.repeat(np.arange(len(first)), lengths + 1)
    place = np.arange(begins[-1]) - begins[segment] + first[segment]
    x = ids[np.minimum(place, len(ids) - 1)].copy()
    stops = begins[1:] - 1
    x[stops] = int(ids.max()) + 1 + np.arange(len(stops))
    blocks = _blocks(x)
    levels = range(2, max(3, len(x).bit_length()))
    rows = np.concatenate([none, *(_across(segment, lengths, blocks, level) for level in levels)])
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # of equal stretches the smallest period is the run's
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
    out = np.stack([place[rows[:, 0]], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run, behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def search(texts: list[str | None]) -> tuple[list[np.ndarray], list[int], list[str]]:
    """Of each whole text its runs, its number of words, and the words that are not dropped, joined by a space."""
    runs, counts, kept = [], [], []
    group: list[list[str]] = []

    def flush() -> None:
        numbers, base = [np.zeros(0, np.int64)], 0
        for words in group:
            of = {w: base + i for i, w in enumerate(dict.fromkeys(words))}
            numbers.append(np.fromiter(map(of.__getitem__, words), np.int64, len(words)))
            base += len(of)
        found, at = find_runs(np.concatenate(numbers)), 0
        bounds = np.searchsorted(found[:, 0], np.cumsum([0, *map(len, group)]))
        for words, lo, hi in zip(group, bounds, bounds[1:]):
            own = found[lo:hi] - [at, 0, 0]
            at += len(words)
            runs.append(own)
            counts.append(len(words))
            if len(own):
                gone = _dropped(own, len(words)).tolist()
                words = [w for w, g in zip(words, gone) if not g]
            kept.append(" ".join(words))
        group.clear()

    size = 0
    for text in texts:
        words = _WORD.findall(text or "")
        if group and size + len(words) > AT_ONCE:
            flush()
            size = 0
        group.append(words)
        size += len(words)
    flush()
    return runs, counts, kept


def _searched(column: str):
    """mapInArrow: each row with what was found in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, counts, kept = search(batch.column(column).to_pylist())
            rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=_RUN.names)
            listed = pa.ListArray.from_arrays(np.cumsum([0, *map(len, runs)]).astype(np.int32), values)
            added = [listed, pa.array(counts, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *_FOUND.names])

    return run


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first of the array; null without one."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` (the text
    with one period left of each run, words joined by one space).

    A run is a stretch of consecutive words, length >= max(6, 4 * period) for its smallest period, that no neighbouring
    word extends. A null or empty text, or one of white space, has no word, no run and an empty ``collapsed``. Each row is
    judged by itself: equal keys or texts, in whatever number, are no case of their own; an empty table gives no rows. Of
    columns named like an added one the added one stays. A task holds a batch of rows and the words of 200,000 or of one
    longer text; memory follows the longest text, its block names take 4 bytes for each word and power of two.
    """
    shield = Shield(docs)
    schema = T.StructType([*shield.df.schema.fields, *_FOUND.fields])
    out = shield.df.mapInArrow(_searched(shield(text)), schema)
    return shield.restored(out, n_words="_n", runs="_runs", collapsed="_kept")


def planted(key: str, text: str) -> Column:
    """The text of the registered query: of a tenth of the documents, chosen by the CRC-32 of the key, the words behind
    one of them repeat from there on. The rest (and rows with a null key) stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")).otherwise("")

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    return F.when(F.col(text).isNotNull() & (h % 10 == 0), F.get(F.transform(F.array(words), edited), F.lit(0))).otherwise(F.col(text))


def op13(docs: DataFrame) -> DataFrame:
    """The digest of :func:`periodic_runs` over documents, a tenth of them edited to hold long runs."""
    out = periodic_runs(docs.select("doc_id", planted("doc_id", "text").alias("text"))).withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda x: F.format_string("%d,%d,%d\n", x["start"], x["length"], x["period"])), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x))")} AS h FROM documents, {CRC_TABLE_SQL}),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND n > 0 AS chosen, (h // 10) % greatest(n, 1) AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d),
e AS (SELECT doc_id, n, CASE WHEN chosen THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM e),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
found AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
best AS (SELECT doc_id, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DECIMAL(38, 12) / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS c, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT e.doc_id, coalesce(c, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM e LEFT JOIN best ON best.doc_id = e.doc_id LEFT JOIN listed ON listed.doc_id = e.doc_id LEFT JOIN kept ON kept.doc_id = e.doc_id
"""
