"""Near-duplicates by SimHash, linked through meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart have a common variant at most 2 bits from each. So every distinct fingerprint
gives all 2081 variants within 2 bits; variants meet by value in a shuffle; and fingerprints that gave the same variant
are linked (they are within 2 + 2 bits; the distance is verified all the same). No pairs inside a group are listed: the
fingerprints of one variant are linked to the smallest of them, which loses no connection.

Variants are many, so they travel packed: eight bytes each, holding the variant without its leading bits (these are the
shuffle key) and the number of the mask that made it, from which the fingerprint follows. The key space is worked off
in passes, one after the other, so that the disk holds the variants of one pass only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm.common import Shield, checkpoint, dropping_shuffles, pieces, shared_path
from citegrid.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bytes of a text that are hashed at once.
PIECE = 1 << 18
#: A bijection of 64-bit numbers that spreads fingerprints over the keys: multiplication by an odd constant.
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_MASK_BITS = 12
#: Passes over the key space: as many as keep one under PASS_BYTES of packed variants, 1 to PASSES.
PASSES, PASS_BYTES = 8, 1 << 29
#: Fingerprints whose variants are gathered before they are sent, and those expanded at once.
SEND, EXPAND = 1024, 128
#: Variants that one shuffle key holds on average, at most.
PER_KEY = 1 << 20


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of one whole text, which is worked off in pieces of PIECE bytes."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower(), PIECE):
        words = words[1 - SHINGLE :] + piece.split()
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))]
        n += len(hashes)
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint as a long of the same 64 bits."""
    return pd.Series(np.array([fingerprint_of(t) for t in text], np.uint64).view(np.int64))


def masks() -> np.ndarray:
    """All 64-bit numbers with at most RADIUS / 2 bits set."""
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])], np.uint64)


def _variants(key_bits: int, passes: int, at: int):
    """The map side of one pass: packed variants whose key falls into it, as (key, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks()
        number = np.arange(len(flips), dtype=np.uint64)
        up, down = np.uint64(64 - key_bits), np.uint64(key_bits)

        def send(points: np.ndarray) -> pa.RecordBatch:
            keys, packed = [], []
            for k in range(0, len(points), EXPAND):
                h = (points[k : k + EXPAND, None] ^ flips[None, :]) * np.uint64(_ODD)
                key = h >> up
                own = (key & np.uint64(passes - 1)) == np.uint64(at)
                keys.append(key[own])
                packed.append((((h[own] << down) >> down) << np.uint64(_MASK_BITS)) | np.broadcast_to(number, h.shape)[own])
            key, value = np.concatenate(keys).astype(np.uint32 if key_bits <= 32 else np.uint64), np.concatenate(packed)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.intp)
            offsets = np.append(starts, len(key)) * 8
            blobs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(value)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(key[starts].astype(np.int64)), blobs], ["key", "blob"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= SEND:
                points = np.concatenate(held)
                whole = len(points) - len(points) % SEND
                for k in range(0, whole, SEND):
                    yield send(points[k : k + SEND])
                held = [points[whole:]]
        if held and len(points := np.concatenate(held)):
            yield send(points)

    return run


def links_of(packed: np.ndarray, key: int, key_bits: int, flips: np.ndarray) -> np.ndarray:
    """n x 2 distinct links from the packed variants of one key."""
    packed = np.sort(packed)
    low = packed >> np.uint64(_MASK_BITS)
    same = low[1:] == low[:-1]
    if not same.any():
        return np.zeros((0, 2), np.uint64)
    hit = np.zeros(len(low), bool)
    hit[1:] = hit[:-1] = False
    hit[1:] |= same
    hit[:-1] |= same
    low, number = low[hit], (packed[hit] & np.uint64((1 << _MASK_BITS) - 1)).astype(np.intp)
    high = np.uint64(key) << np.uint64(64 - key_bits)
    points = ((low | high) * np.uint64(_BACK)) ^ flips[number]
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(points, starts), np.diff(np.append(starts, len(low))))
    links = np.stack([smallest, points], axis=1)[smallest != points]
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS]
    order = np.lexsort((links[:, 1], links[:, 0]))
    links = links[order]
    return links[np.concatenate([[True], (links[1:] != links[:-1]).any(axis=1)])] if len(links) else links


def _links(key_bits: int):
    """The reduce side: rows sorted by key, one key's variants at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks()
        now, held, out, sent = None, [], [], 0

        def done() -> None:
            if held:
                out.append(links_of(np.frombuffer(b"".join(held), np.uint64), now, key_bits, flips))

        def batch_of(links: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(links)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])] if len(both) else both
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    done()
                    now, held = key, []
                    sent = sum(map(len, out))
                    if sent > 500_000:
                        yield batch_of(out)
                        out.clear()
                held.append(blob)
        done()
        if out:
            yield batch_of(out)

    return run


def ball_links(points: DataFrame, passes: int | None = None) -> DataFrame:
    """(fp long, distinct) -> (a, b): links whose connected components are those of all pairs within RADIUS bits."""
    spark = points.sparkSession
    count = points.count()
    key_bits = max(_MASK_BITS, math.ceil(math.log2(max(1, count) * len(masks()) / PER_KEY)))
    if passes is None:  # a power of two; any number gives the same links
        passes = min(PASSES, 1 << max(0, math.ceil(math.log2(max(1, count * len(masks()) * 8 / PASS_BYTES)))))
    path, schema = shared_path(spark, "links"), "a long, b long"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for at in range(passes):
        packed = points.select("fp").repartition(tasks).mapInArrow(_variants(key_bits, passes, at), "key long, blob binary")
        links = packed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_links(key_bits), schema)
        with dropping_shuffles(spark):
            links.write.mode("overwrite").parquet(f"{path}/pass={at}")
    return spark.read.schema(f"{schema}, pass int").parquet(path).select("a", "b").distinct()


def _linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: _key, _tid (a hash of the text), fp, _root (which names the component) and _component (its smallest key)."""
    base = checkpoint(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_tid"), fingerprint(F.col(text)).alias("fp")))  # the one pass over texts
    points = checkpoint(base.groupBy("fp").agg(F.min("_key").alias("_least")))
    roots = connected_components(ball_links(points)).withColumnsRenamed({"node": "_node", "root": "_root"})
    named = points.join(roots, F.col("fp") == F.col("_node"), "left").select("fp", F.coalesce("_root", "fp").alias("_root"), "_least")
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    return base.join(checkpoint(named.join(least, "_root").select("fp", "_root", "_component")), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, fingerprint (16 hex digits) and component_id, the smallest key it is linked to, itself included.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with equal texts are linked
    through their common fingerprint, however many they are; rows with equal keys are rows of their own. A null key is
    never a component's id unless all its keys are null. Very long texts are hashed in pieces, so beside the text itself
    a task holds a few MB. An empty table gives no rows; columns other than the two named are not read.
    """
    return _linked(docs, key, text).select(F.col("_key").alias(key), hex16(F.col("fp")).alias("fingerprint"), F.col("_component").alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest key (null keys last, then the smallest text hash).

    Rows are judged one by one, so of rows with equal keys each stays or goes with its own component. Rows that have
    their key and their text in common are one row.
    """
    first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_tid")).alias("_first")
    found = checkpoint(_linked(docs, key, text).groupBy("_root").agg(first).select("_first._key", "_first._tid"))
    shield = Shield(docs)
    own = shield.df.withColumn("_own", F.xxhash64(shield(text)))
    kept = own.join(found, F.col(shield(key)).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_tid")), "left_semi")
    return shield.restored(kept.dropDuplicates([shield(key), "_own"]))


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
