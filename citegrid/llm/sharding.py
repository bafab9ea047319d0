"""Hilbert-curve sharding: rows near each other in several metadata dimensions share a shard.

Every dimension is quantised into 2**bits equal-frequency steps (strings by their order as a whole), the cell of a row
gets its index on the Hilbert curve, and the rows in curve order are cut into runs of equal length. Readers that filter
on any of the dimensions then skip most shards by the minima and maxima of their files. All of it is DataFrame operations.

The global rank of a row is found without a global sort of rows: cells (at most 2**(bits * dimensions)) are counted and
summed up along the curve; a cell with many rows is split by a hash of key and dimensions into sub-buckets; only inside a
sub-bucket are rows ordered. So one hot cell, even with a third of all rows, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.common import Shield, checkpoint, text_or_empty

#: Sub-buckets that all rows make together; the rows that one holds on average, at least and at most.
BUCKETS, LEAST_ROWS, MOST_ROWS = 4096, 256, 65_536
#: Cells up to which their table is broadcast: some MB.
SMALL_BITS = 16


def _is_string(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def string_bounds(df: DataFrame, name: str, steps: int) -> list[str]:
    """The values at which the steps of a column of strings begin: at most steps - 1 of them come to the driver.

    The distinct values are counted, sorted by range (whole strings, no prefixes), and their counts summed up within each
    range and over the ranges; nothing passes through one task but a row for each range.
    """
    counts = df.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = checkpoint(counts.sort(F.col("_v").asc_nulls_first())).withColumn("_range", F.spark_partition_id())
    ranges = ordered.groupBy("_range").agg(F.sum("_n").alias("_m"))
    ranges = ranges.select("_range", (F.sum("_m").over(Window.orderBy("_range")) - F.col("_m")).alias("_skip"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_range").orderBy(F.col("_v").asc_nulls_first())
    before = F.col("_skip") + F.sum("_n").over(inside) - F.col("_n")
    first = ordered.join(ranges, "_range").select("_v", F.floor(before * steps / F.col("_all")).alias("_step")).groupBy("_step").agg(F.min("_v").alias("_v"))
    return sorted((r["_v"] for r in first.filter("_step > 0").collect()), key=lambda v: v.encode())


def step_bounds(df: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """Per dimension the values at which its 2**bits steps begin: a few dozen values, whatever the input. Of numbers a
    step begins after the value, of strings with it."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [d for d in dims if not _is_string(df, d)]
    row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(f"b{i}") for i, d in enumerate(numbers)]).first() if numbers else ()
    out = {d: sorted(set(row[i] or [])) for i, d in enumerate(numbers)}
    return out | {d: string_bounds(df, d, 2**bits) for d in dims if d not in out}


def step_of(df: DataFrame, name: str, bounds: list) -> Column:
    """The step of a value; null is in the lowest."""
    if not bounds:
        return F.lit(0)
    past = (lambda x: x <= F.col(name)) if _is_string(df, name) else (lambda x: x < F.col(name).cast("double"))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: F.coalesce(past(x), F.lit(False)))), F.lit(0))


def hilbert_index(coords: list[str], bits: int) -> Column:
    """The index of the cell ``coords`` (each 0 .. 2**bits - 1) on the Hilbert curve of that many dimensions.

    The transpose form of the curve: undo excess work from the highest bit down (a fold over the steps), Gray-encode,
    interleave the bits.
    """
    n = len(coords)
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("bit"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        low, first, own = step["bit"] - 1, F.get(x, F.lit(0)), F.get(x, step["i"])
        is_set, swap = own.bitwiseAND(step["bit"]) != 0, first.bitwiseXOR(own).bitwiseAND(low)
        at_first = first.bitwiseXOR(F.when(is_set, low).otherwise(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, at_first).when((j == step["i"]) & ~is_set, v.bitwiseXOR(swap)).otherwise(v))

    def index(x: Column) -> Column:
        gray = [F.get(x, F.lit(0))]
        for j in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(x, F.lit(j))))
        flip = F.lit(0).cast("long")
        for q in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(gray[-1].bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)).cast("long"))
        # the bits of all coordinates, highest first, each coordinate flipped: a fold again, so that flip is written once
        places = F.array(*[F.lit(q * n + i) for q in range(bits) for i in range(n)])
        flipped = F.transform(F.array(*gray), lambda g: g.bitwiseXOR(flip))
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("index"), flipped.alias("g")), interleaved, lambda s: s["index"])

    def interleaved(state: Column, place: Column) -> Column:
        g = F.get(state["g"], n - 1 - place % n)
        bit = F.call_function("shiftright", g, F.floor(place / n).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return F.struct(state["index"].bitwiseOR(F.call_function("shiftleft", bit, place)).alias("index"), state["g"].alias("g"))

    return F.aggregate(steps, F.array(*[F.col(c).cast("long") for c in coords]), undo, index)


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int = 16, bits: int = 4, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` (int, 0 .. n_shards - 1), ``slot`` (long, gapless from 0 within a shard) and ``curve_index``.

    Rows in order of (curve index, hash of key and dimensions, key) are cut into n_shards runs whose lengths differ by one
    at most. Nulls in a dimension are in its lowest step; rows with equal (or null) keys are rows of their own, told apart
    by their dimensions, and by nothing where these are equal too: such rows get slots in any order, from one sorted task.
    An empty table stays empty; other columns, whatever their names and lengths (but for the three added ones, which are
    replaced), pass through. ``docs`` is read several times and must give the same rows each time, as files do.
    """
    shield = Shield(docs)
    docs, dims, key = shield.df, [shield(d) for d in dims], shield(key)
    bounds = step_bounds(docs, dims, bits)
    q = [f"_q{i}" for i in range(len(dims))]
    rows = docs.withColumns({c: step_of(docs, d, bounds[d]) for c, d in zip(q, dims)} | {"_u": F.shiftrightunsigned(F.xxhash64(key, *dims), 33)})

    # Cells along the curve: at most 2**(bits * len(dims)) rows, whatever the input, so they may be windowed.
    along, every = Window.orderBy("curve_index"), Window.partitionBy()
    cells = rows.groupBy(*q).agg(F.count(F.lit(1)).alias("_n")).withColumn("curve_index", hilbert_index(q, bits))
    cells = cells.select(*q, "curve_index", "_n", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("_total"))
    bucket = f"least({MOST_ROWS}, greatest({LEAST_ROWS}, _total div {BUCKETS}))"
    cells = cells.withColumn("_parts", F.expr(f"1 + _n div {bucket}")).drop("_n")
    rows = rows.join(F.broadcast(cells) if bits * len(dims) <= SMALL_BITS else cells, q).withColumn("_part", F.expr("shiftright(_u * _parts, 31)")).drop(*q, "_parts")

    parts = rows.groupBy("curve_index", "_part").agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy("curve_index").orderBy("_part")
    parts = parts.select("curve_index", "_part", (F.sum("_m").over(inside) - F.col("_m")).alias("_skip"))
    rows = rows.join(parts, ["curve_index", "_part"])
    last = Window.partitionBy("curve_index", "_part").orderBy("_u", key)
    rank = F.col("_before") + F.col("_skip") + F.row_number().over(last) - 1
    cut = rows.withColumn("_rank", rank).withColumn("_shard", F.expr(f"cast((_rank * {n_shards}) div _total as int)"))
    return shield.restored(cut, shard="_shard", slot=F.expr(f"_rank - (_shard * _total + {n_shards - 1}) div {n_shards}"), curve_index="curve_index")


def write_shards(sharded: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write one folder for each shard, its rows in slot order, so that file minima and maxima prune in every dimension."""
    sharded.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op3(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The digest of :func:`hilbert_shards` over language, source and length; its law is ``rows``."""
    text = text_or_empty("text")
    slim = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(checkpoint(slim), ["lang", "source", "n_chars"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")
