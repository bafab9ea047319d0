"""Helpers shared by the operators: the shared folder, lineage cuts and small column builders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.storage import checkpoint, dropping_shuffles, shared_dir  # noqa: F401, checkpoint is for the operators

#: Java and Python pattern of one word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths of intermediate tables, by application; see discard_intermediates().
_MADE: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless it is to be kept, discard_intermediates() deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_intermediates(spark: SparkSession) -> None:
    """Delete the tables that operators wrote between their steps.

    Results are lazy and read such tables, so this is for the caller, once the results have been written. (Checkpoints
    go by themselves where spark.cleaner.referenceTracking.cleanCheckpoints is set.)
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for made in _MADE.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)


class Shield:
    """A frame's columns under names that no operator uses, so that none of them clashes; see restored().

    Calling it with a column's name gives the name that stands for it in ``df``.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"in{i}__" for i in range(len(self.names))])

    def __call__(self, name: str) -> str:
        return f"in{self.names.index(name)}__"

    def restored(self, out: DataFrame, **added: Column | str) -> DataFrame:
        """The input's columns by their names, then the added ones, which take the place of any of the same name."""
        old = [F.col(f"in{i}__").alias(n) for i, n in enumerate(self.names) if n not in added]
        return out.select(*old, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in added.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a columnar lineage cut for wide intermediate data."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c: Column | str) -> Column:
    """Number of words as a long; a null text has none."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


#: DuckDB: a row whose ``crc_table`` is the table of CRC-32.
CRC_TABLE_SQL = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table)"


def crc32_sql(numbers: str) -> str:
    """DuckDB expression: the CRC-32 of a list of bytes, where the row's ``crc_table`` is at hand."""
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c // 256, crc_table[1 + xor(c % 256, b)])), 4294967295)"


_POWER, _ODD = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
#: Bytes that are hashed at once. Workers live on from stage to stage, and what they have once touched they keep.
HASH_BYTES = 500_000
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """data in pieces that begin at white space, of ``size`` bytes at most unless a word is longer."""
    at = 0
    while at < len(data):
        cut = len(data)
        if cut - at > size:
            cut = max(data.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut <= at:
                found = _WHITE.search(data, at + size)
                cut = found.start() if found else len(data)
        yield data[at:cut]
        at = cut


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. n - 1 of an odd number modulo 2**64, and their inverses."""
    both = np.ones((2, n), np.uint64)
    both[0, 1:], both[1, 1:] = _POWER, pow(_POWER, -1, 1 << 64)
    both = np.cumprod(both, axis=1, dtype=np.uint64)
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers and inverses. Tables of usual sizes are kept, larger ones, for one long word, are not."""
    size = 1 << max(16, n.bit_length())
    return _powers(size) if size <= 1 << HASH_BYTES.bit_length() else _powers.__wrapped__(size)


@lru_cache(maxsize=4)
def _parting(separators: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer((" \t\n\v\f\r" + separators).encode(), np.uint8)] = True
    return table


def _hashed(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, and where each begins: polynomial sums, all words at once."""
    edge = np.diff(np.concatenate([[0], (~table[x]).view(np.int8), [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, back = powers(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    return h ^ (h >> np.uint64(29)), starts


def hash_words(texts: list[str | None], separators: str = "") -> list[np.ndarray]:
    """Per whole text the hashes of its lower-cased words, which white space and the given ASCII characters part.

    Texts are hashed many at once, and longer ones in pieces cut at white space, so the memory needed is bounded.
    """
    table, out = _parting(separators), []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            h, starts = _hashed(np.frombuffer(b" ".join(group) + b" ", np.uint8), table)
            bounds = np.cumsum([len(b) + 1 for b in group])
            out.extend(np.split(h, np.searchsorted(starts, bounds[:-1])))
            group.clear()

    size = 0
    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if group and size + len(data) > HASH_BYTES:
            flush()
            size = 0
        if len(data) <= HASH_BYTES:
            group.append(data)
            size += len(data)
            continue
        flush()
        size = 0
        out.append(np.concatenate([_hashed(np.frombuffer(piece, np.uint8), table)[0] for piece in pieces(data, HASH_BYTES)]))
    flush()
    return out
