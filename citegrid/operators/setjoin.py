"""Similarity join of token sets: all pairs with a Dice coefficient of at least some value, and no pair lost.

Tokens are ordered by how many sets hold them, the rarest first, as a table of fixed size tells it: any order serves, if it
is the same for all sets, so tokens that share a bucket cost pairs to look at and lose none. Two sets that are similar enough
share a token among the first few of each (their prefixes), so sets meet on these only, on a token that can be the first of
those they share: where it stands in both bounds how many they can share in all; so does a bitmap of 512 bits that each set
carries, and another of 2048 bits where both are large, as a token that only one of two sets has can differ in one bit at most; and
what they share within the prefixes bounds it once more, before a set is looked at as a whole. A token that many sets
hold is split into parts: each set of one side is in one part, each of the other in all, so no task gets all sets of a token.

Where only the best partners of a set are wanted, a bounded look at some tells how many tokens these must share with it at
least; that is one more bound, by which the sets of a group of near copies do not all meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.storage import settled

#: Tolerance of comparisons with products of floating-point numbers, on the side that keeps pairs.
EPS = 1e-9
#: Sets that hold a token for each part it is split into, as its bucket counts them; few of these have it in their prefixes.
PART_SETS = 8192
#: Buckets of hashes in which tokens are counted.
BUCKETS = 1 << 17
#: 64-bit words of the bitmap of a set.
MAP_WORDS = 8
#: Tokens from which on a set has a second, larger bitmap, and the 64-bit words of that.
WIDE_FROM, WIDE_WORDS = 96, 32
#: Sets that hold a token for it to be crowded, and the crowded tokens of a set at which the bounded look is taken.
CROWD, LOOKS = 32, 3
#: Rows of prefixes, and pairs of rows, that are made at once.
_ROWS, _PAIRS = 1 << 15, 1 << 17


def _hashed(sets: DataFrame) -> DataFrame:
    """sets that are not empty, with 64-bit hashes as tokens; those that are numbers already are taken as such."""
    kept = sets.filter(F.size("tokens") > 0)
    if kept.schema["tokens"].dataType.simpleString() == "array<bigint>":
        return kept
    return kept.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))


def _bitmaps(token: np.ndarray, row: np.ndarray, rows: int, words: int) -> np.ndarray:
    """A bit for each token, by its hash, in so many longs for each row."""
    bit = row * (64 * words) + token % (64 * words)
    bits = np.zeros(rows * 64 * words, bool)
    bits[bit] = True
    return np.packbits(bits, bitorder="little").view(np.int64).reshape(rows, words)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many tokens of all sets fall into each bucket of hashes, a table of fixed size."""
    rows = sets.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _binary(maps: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, null where there are none."""
    ends = np.concatenate([[0], np.cumsum(present)]) * maps.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(maps), [pa.py_buffer(np.packbits(present, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(maps[present]))])


def _prefixes(sets: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(id, tokens, others) -> (id, others, n, map, wide, at, token, df, late): the tokens of each prefix and their places, counted
    from 1, late among the crowded ones (else 0). A column named floor is a number of tokens that must be shared."""
    others = [c for c in sets.columns if c not in ("id", "tokens")]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy().astype(np.int64)
            token, row = pc.list_flatten(batch.column("tokens")).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            maps, large = _bitmaps(token, row, len(sizes), MAP_WORDS), sizes >= WIDE_FROM
            wide = np.zeros((len(sizes), WIDE_WORDS), np.int64)
            wide[large] = _bitmaps(token[large[row]], (np.cumsum(large) - 1)[row[large[row]]], large.sum(), WIDE_WORDS)
            df = counts[token % BUCKETS]
            order = np.lexsort((token, df, row))
            token, df, n = token[order], df[order], sizes[row]
            start = np.cumsum(sizes) - sizes
            at = np.arange(len(row)) - start[row] + 1
            crowded = np.cumsum(df >= CROWD)
            late = np.where(df >= CROWD, crowded - np.concatenate([[0], crowded])[start[row]], 0)
            shared = np.maximum(1, np.ceil(least / (2 - least) * n - EPS))
            if "floor" in others:
                shared = np.maximum(shared, pc.fill_null(batch.column("floor"), 0).to_numpy()[row])
            kept = np.flatnonzero((at <= n - shared + 1) & (df > 0))
            for k in np.split(kept, range(_ROWS, len(kept), _ROWS)):
                of = row[k]
                made = {c: batch.column(c).take(pa.array(of)) for c in ("id", *others)}
                made |= {"n": pa.array(n[k].astype(np.int32)), "map": _binary(maps[of], np.ones(len(of), bool)), "wide": _binary(wide[of], large[of])}
                made |= {"at": pa.array(at[k].astype(np.int32)), "token": pa.array(token[k]), "df": pa.array(df[k]), "late": pa.array(late[k].astype(np.int32))}
                yield pa.RecordBatch.from_pydict(made)

    kind = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in ("id", *others))
    return sets.mapInArrow(ranked, f"{kind}, n int, map binary, wide binary, at int, token bigint, df bigint, late int")


def _need(least: float) -> Column:
    """How many tokens sets of n and of m tokens share if they are similar enough."""
    return F.ceil(least / 2 * (F.col("n") + F.col("m")) - EPS)


def _bar(least: float, floors: bool) -> Column:
    """How many tokens two sets must share to be a result."""
    if not floors:
        return _need(least)
    return F.greatest(_need(least), F.coalesce(F.col("floor") + (F.col("first") > F.col("last")).cast("int"), F.lit(0)))


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Bitmaps as rows of numbers, without those that are null."""
    column = column.drop_null()
    start = column.offset
    ends = np.frombuffer(column.buffers()[1], np.int32)[start : start + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint64)[ends[0] // 8 : ends[-1] // 8].reshape(len(column), words) if len(column) else np.zeros((0, words), np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of bitmaps differ."""
    counts = np.bitwise_count(a ^ b).view(np.uint64)  # eight counts of a byte each
    low = np.uint64(0x00FF00FF00FF00FF)
    sums = ((counts & low) + ((counts >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)
    return (sums[:, 0] if sums.shape[1] == 1 else sums.sum(1)).astype(np.int32)


def _meetings(least: float, alone: bool, floors: bool):
    """The task side of _join(): rows of both sides in order of token, part and side, the right one's first."""
    share = least / (2 - least)

    def pairs(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, partner) of the partners lo to hi - 1 of each place, some at a time, if n of the one is within most of the other."""
        count = np.maximum(hi - lo, 0)
        ends = np.cumsum(count)
        cuts = np.searchsorted(ends, np.arange(_PAIRS, ends[-1] + _PAIRS, _PAIRS) if len(ends) else [], "left") + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            c = count[a:b]
            partner = np.repeat(lo[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            some = np.flatnonzero(np.repeat(n[a:b], c) <= most[partner])
            if len(some):
                yield np.repeat(np.arange(a, a + len(c)), c)[some], partner[some]

    def met(window: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, ids, n, at = (window.column(c).to_numpy() for c in ("side", "id", "n", "at"))
        floor = pc.fill_null(window.column("floor"), 0).to_numpy() if floors else np.zeros(len(n), np.int32)
        maps = _words(window.column("map"), MAP_WORDS)
        large, wide = window.column("wide").is_valid().to_numpy(zero_copy_only=False), _words(window.column("wide"), WIDE_WORDS)
        place = np.cumsum(large) - 1
        # with n and m tokens they must share so many; if the i-th of one and the j-th of the other is the first they share,
        # so many they can. For each place of one set that is a greatest size of the other
        most = np.minimum(np.floor((1 + n - at + EPS) * 2 / least - n + 1e-6), 1 << 30).astype(np.int64)
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        right = right[np.lexsort((n[right], group[right]))]
        key, base = (group[right] << 40) + n[right], group[left] << 40
        lo = np.maximum(np.ceil(share * n[left] - 1e-6).astype(np.int64), floor[left])
        hi = np.minimum(np.floor(n[left] / share + 1e-6).astype(np.int64), most[left])
        lo, hi = np.searchsorted(key, base + lo, "left"), np.searchsorted(key, base + np.maximum(hi, 0), "right")
        for x, y in pairs(lo, hi, n[left], most[right].astype(np.int32)):
            x, y = left.take(x), right.take(y)
            nx, ny = n.take(x), n.take(y)
            both, can = nx + ny, 1 + np.minimum(nx - at.take(x), ny - at.take(y))
            bar = np.maximum(np.ceil(least / 2 * both - EPS).astype(np.int32), floor.take(x))
            some = (can >= bar) & (ny >= share * nx - EPS) & (nx >= share * ny - EPS)
            if alone or floors:
                some &= (ids.take(x) < ids.take(y)) if alone else (ids.take(x) != ids.take(y))
            x, y, both, bar, can = (v.compress(some) for v in (x, y, both, bar, can))
            can = np.minimum(can, (both - _apart(maps.take(x, 0), maps.take(y, 0))) // 2)
            x, y, both, bar, can = (v.compress(can >= bar) for v in (x, y, both, bar, can))
            two = np.flatnonzero(large[x] & large[y])
            can[two] = np.minimum(can[two], (both[two] - _apart(wide[place[x[two]]], wide[place[y[two]]])) // 2)
            some = can >= bar
            x, y, can = x[some], y[some], can[some]
            if len(x):
                made = {"x": ids[x], "y": ids[y], **{k: v.astype(np.int32) for k, v in (("n", n[x]), ("m", n[y]), ("i", at[x]), ("j", at[y]), ("can", can))}}
                made = {k: pa.array(v) for k, v in made.items()}
                if floors:
                    of = pa.array(x)
                    made |= {"floor": window.column("floor").take(of), "last": window.column("last").take(of), "first": window.column("first").take(pa.array(y))}
                yield pa.RecordBatch.from_pydict(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            window = batch if held is None else pa.concat_batches([held, batch])
            if not window.num_rows:
                continue
            token, part = window.column("token").to_numpy(), window.column("part").to_numpy()
            group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
            yield from met(window, group)
            # of the last token's sets those of the right side are kept for what comes of the left one
            held = window.take(pa.array(np.flatnonzero((group == group[-1]) & (window.column("side").to_numpy() == 0))))

    return run


def _join(a: DataFrame, b: DataFrame, least: float, alone: bool = False, floors: bool = False) -> DataFrame:
    """A row for each token on which two sets meet, of prefixes a and b (ids are longs), that the bounds can't part; can:
    how many tokens they share at most. With floors a has floor and last, b has first, and equal ids don't meet.

    Of a pair's shared tokens the first ones pass, so in the end their number counts all up to the last that did.
    """
    parts = (1 + F.floor(F.col("df") / PART_SETS)).cast("int")
    columns, kind = ["id", "n", "map", "wide", "at"], b.schema["first"].dataType.simpleString() if floors else ""
    null = lambda k, c: [F.lit(None).cast(k).alias(c)] if floors else []
    b = b.select("token", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("side"), *columns, *null("int", "floor"), *null(kind, "last"), *(["first"] if floors else []))
    a = a.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("side"), *columns, *(["floor", "last"] if floors else []), *null(kind, "first"))
    rows = a.unionByName(b).repartition("token", "part").sortWithinPartitions("token", "part", "side")
    return rows.mapInArrow(_meetings(least, alone, floors), "x bigint, y bigint, n int, m int, i int, j int, can int" + (f", floor int, last {kind}, first {kind}" if floors else "")).filter(F.col("can") >= _bar(least, floors))


def _pairs(met: DataFrame, least: float, floors: bool = False) -> DataFrame:
    """(x, y), each pair once, of those that met and that what they share within the prefixes can't part."""
    keys = ["x", "y", "n", "m", *(["floor", "last", "first"] if floors else [])]
    found = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    rest = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return found.filter(F.col("c") + rest >= _bar(least, floors)).select("x", "y")


def _met(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """A row for each token on which two sets meet that the bounds can't part."""
    left = _hashed(left.select("id", "tokens"))
    held = left if right is None else _hashed(right.select("id", "tokens"))
    counts = _frequencies(held)
    return _join(_prefixes(left, counts, least), _prefixes(held, counts, least), least, right is None)


def candidates(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """left and right: (id: long, tokens: array of distinct strings), ids distinct on each side -> (x, y), each pair once.

    Holds every pair of sets with a Dice coefficient of at least ``least`` (above 0), and others that the bounds can't tell
    from such. With ``right`` None pairs are those of left with itself, x < y. Empty and null sets have no partner.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1: sets that share nothing can't be joined")
    return _pairs(_met(left, right, least), least)


def _shared(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs as (x, keys, shared) with the number of tokens that they do share, if they are similar enough."""
    j = pairs.join(left.select(F.col("id").alias("x"), F.col("tokens").alias("_l")), "x").join(right.select(F.col("id").alias("y"), F.col("tokens").alias("_r"), "keys"), "y")
    j = j.select("x", "keys", F.size("_l").alias("n"), F.size("_r").alias("m"), F.size(F.array_intersect("_l", "_r")).alias("shared"))
    return j.filter(F.lit(2.0) * F.col("shared") / (F.col("n") + F.col("m")) >= least - EPS).select("x", "keys", "shared")


def _floors(left: DataFrame, right: DataFrame, same: DataFrame, counts: np.ndarray, least: float, k: int) -> DataFrame:
    """left with floor and last: so many tokens the k-th best key shares with the set at least, and if just so many, it is
    that key or a smaller one. Null where the look found no k keys.

    A set looks at two sets for each of its first crowded tokens: one of those with most keys, one that has fewest tokens
    before it. Those are the most typical of a group of near copies, and how many are looked at does not grow with the group.
    """
    b = _prefixes(right.select("id", "tokens", F.element_at("keys", 1).alias("first"), F.size("keys").alias("held")), counts, least).filter(F.col("df") >= CROWD)
    row, size = F.struct("id", "n", "map", "wide", "at", "df", "first"), [-F.col("n"), F.col("first"), F.col("id")]
    seen = b.groupBy("token").agg(F.min_by(row, F.struct(-F.col("held"), "at", *size)).alias("u"), F.min_by(row, F.struct("at", *size)).alias("v"))
    seen = seen.select("token", F.explode(F.array_distinct(F.array("u", "v"))).alias("s")).select("token", "s.*")
    a = _prefixes(left, counts, least).filter(F.col("late").between(1, LOOKS))
    pairs = _join(a.withColumns({"floor": F.lit(None).cast("int"), "last": F.lit(None).cast(seen.schema["first"].dataType)}), seen, least, floors=True).select("x", "y").distinct()
    known = _shared(pairs, left, right, least).unionByName(same).select("x", F.explode("keys").alias("key"), "shared")
    best = F.get(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("less"), "key"))), F.lit(k - 1))
    floors = known.groupBy("x").agg(best.alias("b")).filter("b IS NOT NULL").select(F.col("x").alias("id"), (-F.col("b.less")).alias("floor"), F.col("b.key").alias("last"))
    return left.join(floors, "id", "left")


def _close(left: DataFrame, right: DataFrame, same: DataFrame, least: float, k: int) -> DataFrame:
    """The pairs of different sets (x, y) that have to be looked at as a whole for best()."""
    counts = _frequencies(right)
    asked = settled(_floors(left, right, same, counts, least, k), "floors")
    held = right.select("id", "tokens", F.element_at("keys", 1).alias("first"))
    return _pairs(_join(_prefixes(asked, counts, least), _prefixes(held, counts, least), least, floors=True), least, True)


def best(left: DataFrame, right: DataFrame, least: float, k: int) -> DataFrame:
    """left: (id, tokens), right: (id, tokens, keys: sorted, k at most) -> (x, shared, key, rank): for each set of left the k
    keys of sets that share most tokens with it (ties by key), of those with a Dice coefficient of at least ``least``.

    Tokens are distinct hashes, ids hashes of the sets: equal sets have equal ids. No set is empty.
    """
    same = left.join(right, "id").select(F.col("id").alias("x"), "keys", F.size(left["tokens"]).alias("shared"))
    found = _shared(settled(_close(left, right, same, least, k), "close"), left, right, least).unionByName(same)
    order = Window.partitionBy("x").orderBy(F.desc("shared"), "key")
    return found.select("x", "shared", F.explode("keys").alias("key")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
