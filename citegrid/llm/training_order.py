"""Training-order materialisation: token-ID sequences in a keyed pseudo-random order, as fixed-stride binary shards.

1. Texts are dealt by a hash of their key and tokenised once; their token IDs go to a written table. A document is cut
   into sequences of ``length`` tokens, the last one padded. Documents in order of (hash, key) number all sequences
   0 .. n - 1: the sums of the hash parts, of about PART_BYTES of text each, are the only global state.
2. A Feistel network over the next even number of bits is a permutation; walking its cycles until a value below n comes
   makes it one of 0 .. n - 1. It gives each sequence its slot in the training order, row by row, for any corpus size.
3. Slots are dealt by range, a range for each shard, sorted, and written: shard i holds slots i * rows .. (i + 1) * rows - 1, each slot exactly
   2 * length bytes, so slot s of training lies at byte (s mod rows) * 2 * length. Ranges of shards are worked off in
   passes; a pass that was completed is skipped when the job is started again. A manifest of the parameters and of the
   documents' number and checksum guards the folder: started with others, the job fails rather than mix two orders.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm import tokens
from citegrid.llm.common import dropping_shuffles, shared_path

LENGTH, ROWS, PASSES, KEY, ROUNDS = 256, 16_384, 4, 20_240_229, 6
#: Bytes of text in a hash part on average; hash bits of parts, at least and at most. The order does not depend on them.
PART_BYTES, PART_BITS = 1 << 25, (6, 24)
#: Shards, and so tasks, of a pass at most: with more shards there are more passes.
PASS_SHARDS = 20_000


def feistel(values: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to an array of such numbers."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}:{r}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        return (left << np.uint64(half)) | right

    out = once(values.astype(np.uint64))
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = once(out[over])
    return out.astype(np.int64)


def _tokenised(vocabulary: Broadcast, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = tokens.encoding(vocabulary.value)
        now, first = None, 0
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for part, key, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if part != now:
                    now, first = part, 0
                ids = np.array([t for piece in tokens.pieces(text) for t in encoding.encode_ordinary(piece)] + [end], np.uint16)
                n = -(-len(ids) // length)
                out.append((part, key, first, n, ids.tobytes()))
                first += n
                size += 2 * len(ids)
                if size > 4_000_000:
                    yield _token_batch(out, batch.schema.field(1).type)
                    out, size = [], 0
            if out:
                yield _token_batch(out, batch.schema.field(1).type)

    return run


def _token_batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    part, key, first, n, tokens = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([k.as_py() for k in key], key_type), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], ["part", "_key", "first", "n", "tokens"])


def _sequences(n: int, length: int, rows: int, key: int, low: int, high: int, key_type: T.DataType):
    """Tokenised documents -> their sequences whose slots lie in [low, high): shard, slot, key, sequence, n_tokens, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, count = batch.column("start").to_numpy(), batch.column("n").to_numpy()
            doc = np.repeat(np.arange(len(start)), count)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            slot = feistel(start[doc] + number, n, key)
            own = np.flatnonzero((slot >= low) & (slot < high))
            if not len(own):
                continue
            arrays = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("tokens")]
            data, sizes = [], []
            for d, k in zip(doc[own].tolist(), number[own].tolist()):
                piece = arrays[d][k * length : (k + 1) * length]
                sizes.append(len(piece))
                data.append(piece.tobytes() if len(piece) == length else np.concatenate([piece, np.full(length - len(piece), arrays[d][-1])]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(slot[own] // rows), pa.array(slot[own]), batch.column("_key").take(pa.array(doc[own])), pa.array(number[own]), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["shard", "slot", "_key", "sequence", "n_tokens", "data"])

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("_key", key_type), T.StructField("sequence", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("data", T.BinaryType())])
    return run, schema


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; any scheme that pyarrow knows, a plain path is local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _writer(folder: str, rows: int, key_type: T.DataType):
    """Sequences sorted by slot -> shard files, and a row of the index for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        now, stream, temporary = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                system.move(temporary, f"{base}/{shard_name(now)}")  # whole or not there; a second attempt writes the same

        for batch in batches:
            shard, data = batch.column("shard").to_pylist(), batch.column("data")
            sums = []
            for s, x in zip(shard, data):
                if s != now:
                    close()
                    now, temporary = s, f"{base}/.{shard_name(s)}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                buffer = x.as_buffer()
                stream.write(buffer)
                sums.append(zlib.crc32(buffer))
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("sequence"), batch.column("n_tokens"), batch.column("slot"), batch.column("shard"), pa.array(slot % rows), pa.array(sums, pa.int64())], ["_key", "sequence", "n_tokens", "slot", "shard", "record", "crc32"])
        close()

    schema = T.StructType([T.StructField("_key", key_type), T.StructField("sequence", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("record", T.LongType()), T.StructField("crc32", T.LongType())])
    return run, schema


def _guarded(spark: SparkSession, folder: str, facts: dict) -> None:
    """Write the manifest of a new folder; fail if the folder's manifest has other facts."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    files, mine = path.getFileSystem(conf), json.dumps(facts, sort_keys=True)
    if files.exists(path):
        found = "\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect())
        if found != mine:
            raise ValueError(f"{folder} holds the order of other documents or parameters: {found}, not {mine}")
        return
    out = files.create(path, False)
    try:
        out.write(bytearray(mine.encode()))
    finally:
        out.close()


def _done(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialise(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = tokens.TOKENIZER, length: int = LENGTH, rows: int = ROWS, passes: int = PASSES, secret: int = KEY) -> DataFrame:
    """Write the shards to ``folder``/shards and return their index, one row for each sequence: key, sequence (its number
    in the document), n_tokens (without padding), slot, shard, record (its number in the shard) and crc32 of its bytes.

    The folder must be one that all executors and the driver share. Started again on the same folder with the same
    documents and parameters, finished steps and passes are skipped; with others it is an error. Every text ends with the
    end token (the first ID that the vocabulary leaves free), which also pads; a null or empty text has no sequences;
    equal rows are sequences of their own; without sequences no shard is written. Of rows with equal keys those first come
    first whose text hash is smaller. A text of any length is tokenised in pieces and its IDs are one value of the table.
    Rows of one key (or of null keys) are one hash part, read by one task. Other columns are not read.
    """
    spark, folder = docs.sparkSession, folder.rstrip("/")
    kind, vocabulary = docs.schema[key].dataType, tokens.vocabulary(tokenizer)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    sums = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text")), F.sum(F.xxhash64("_key", "_text").cast("decimal(38,0)"))).first()
    _guarded(spark, folder, {"documents": sums[0], "bytes": sums[1] or 0, "checksum": str(sums[2] or 0), "length": length, "rows": rows, "passes": passes, "secret": secret, "vocabulary": hashlib.sha256(vocabulary).hexdigest()})
    bits = min(PART_BITS[1], max(PART_BITS[0], ((sums[1] or 0) // PART_BYTES).bit_length()))
    table = f"{folder}/tokens"
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("_key", kind), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType())])
    if not _done(spark, table):
        dealt = texts.withColumn("_u", F.shiftrightunsigned(F.xxhash64("_key"), 32)).withColumn("_part", F.shiftright("_u", 32 - bits).cast("int")).repartition("_part")
        dealt = dealt.withColumn("_tie", F.xxhash64("_text")).sortWithinPartitions("_part", "_u", "_key", "_tie").select("_part", "_key", "_text")
        with dropping_shuffles(spark):
            dealt.mapInArrow(_tokenised(spark.sparkContext.broadcast(vocabulary), length), schema).write.mode("overwrite").option("compression", "zstd").parquet(table)
    tokenised = spark.read.schema(schema).parquet(table)
    sums = tokenised.groupBy("part").agg(F.sum("n").alias("_n"))
    bases = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))  # a row for each part
    total = sums.agg(F.sum("_n")).first()[0] or 0
    documents = tokenised.join(F.broadcast(bases), "part").select("_key", (F.col("_base") + F.col("first")).alias("start"), "n", "tokens")

    system, base = open_folder(f"{folder}/shards")
    system.create_dir(base, recursive=True)
    shards, index = -(-total // rows), f"{folder}/index"
    passes = max(passes, -(-shards // PASS_SHARDS))
    write, index_schema = _writer(f"{folder}/shards", rows, kind)
    for p in range(passes):
        low, high = shards * p // passes, shards * (p + 1) // passes
        if _done(spark, f"{index}/pass={p}"):
            continue
        cut, cut_schema = _sequences(total, length, rows, secret, low * rows, high * rows, kind)
        moved = documents.mapInArrow(cut, cut_schema).repartitionById(max(1, high - low), (F.col("shard") - low).cast("int")).sortWithinPartitions("shard", "slot")
        with dropping_shuffles(spark):
            moved.mapInArrow(write, index_schema).write.mode("overwrite").parquet(f"{index}/pass={p}")
    out = spark.read.schema(T.StructType([*index_schema.fields, T.StructField("pass", T.IntegerType())])).parquet(index)
    return out.drop("pass").withColumnRenamed("_key", key)


def read_slots(folder: str, first: int, n: int, length: int = LENGTH, rows: int = ROWS) -> np.ndarray:
    """n x length token IDs of the slots from ``first`` on: what a trainer reads when it starts or resumes there."""
    system, base = open_folder(f"{folder.rstrip('/')}/shards")
    out = []
    while n > 0:
        shard, record = divmod(first, rows)
        take = min(n, rows - record)
        with system.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(record * length * 2)
            data = f.read(take * length * 2)
        if not data:
            break
        out.append(np.frombuffer(data, np.uint16).reshape(-1, length))
        first, n = first + take, n - take
    return np.concatenate(out) if out else np.zeros((0, length), np.uint16)


def op5(docs: DataFrame) -> DataFrame:
    """The index of all sequences of documents, their shards written to a new folder in the shared folder."""
    return materialise(docs.select("doc_id", "text"), shared_path(docs.sparkSession, "training-order", keep=True))
