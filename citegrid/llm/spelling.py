"""Spelling variants: words at edit distance one, each with its most frequent neighbour as its form.

The vocabulary is cut into ranges of sorted words, and each becomes a compact trie: labels of single-child paths as one
string, nodes in breadth-first order as flat arrays, so that the children of a node are neighbours. Tries are broadcast,
as many at once as stay under a bound of bytes; beyond it the vocabulary is gone through once more for each further pass.
In a task every word's distance-one Levenshtein automaton walks each trie depth-first: as long as no edit is made there is
one path, and from each of its places an edit leads to a path without choice. What accepts is a neighbour; its count and
the best form are reduced at once, so a word gives one row for each pass however many neighbours it has.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.common import CRC_TABLE_SQL, Shield, checkpoint, crc32_sql, dropping_shuffles, shared_path

#: Fixed by the contract of the registered query.
RUN, MIN_CHARS, MIN_COUNT, TYPO_EVERY, MORE_THAN = r"[A-Za-zÀ-ÿ]+", 5, 3, 97, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one trie, bytes of the tries that are broadcast at once, words that one task looks up on average.
SHARD_WORDS, PASS_BYTES, TASK_WORDS = 1 << 17, 1 << 25, 1 << 13


class Trie:
    """A compact trie over distinct words with counts above 0. Node i has the label blob[start[i]:start[i + 1]] (only the
    root's may be empty), the children child[i] .. child[i + 1] - 1, whose first characters are in heads, and count[i],
    which is 0 where no word ends."""

    __slots__ = ("blob", "heads", "start", "child", "count")

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """The trie of words in code-point order."""
        t, labels = cls(), []
        t.start, t.child, t.count = array("I", [0]), array("I"), array("q")
        todo, size = [(0, len(words), 0)], 0
        for low, high, at in todo:  # grows in the loop: breadth first
            first, last, end = words[low], words[high - 1], at
            most = min(len(first), len(last))
            while end < most and first[end] == last[end]:
                end += 1
            labels.append(first[at:end])
            size += end - at
            t.start.append(size)
            ends = len(first) == end
            t.count.append(counts[low] if ends else 0)
            low += ends
            t.child.append(len(todo))
            while low < high:
                after = bisect_left(words, first[:end] + chr(ord(words[low][end]) + 1), low, high)
                todo.append((low, after, end))
                low = after
        t.child.append(len(todo))
        t.blob = "".join(labels)
        t.heads = "".join([" ", *(x[0] for x in labels[1:])])
        return t

    def dumped(self) -> tuple[bytes, ...]:
        return (self.blob.encode(), self.heads.encode(), self.start.tobytes(), self.child.tobytes(), self.count.tobytes())

    @classmethod
    def loaded(cls, parts: tuple[bytes, ...]) -> Trie:
        t = cls()
        t.blob, t.heads, t.start, t.child, t.count = parts[0].decode(), parts[1].decode(), array("I", parts[2]), array("I", parts[3]), array("q", parts[4])
        return t

    def rest(self, node: int, at: int, word: str, i: int) -> int:
        """The node where word[i:] ends as a word, read from place ``at`` in the node's label on; -1 if it does not."""
        blob, start, child, heads = self.blob, self.start, self.child, self.heads
        while True:
            size = start[node + 1] - at
            if size and blob[at : at + size] != word[i : i + size]:
                return -1
            i += size
            if i >= len(word):
                return node if i == len(word) and self.count[node] else -1
            node = heads.find(word[i], child[node], child[node + 1])
            if node < 0:
                return -1
            at, i = start[node] + 1, i + 1

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(neighbour, count) of the words at distance one, each once."""
        blob, start, child, heads, count, rest = self.blob, self.start, self.child, self.heads, self.count, self.rest
        n, node, i = len(word), 0, 0
        while True:
            at, end = start[node], start[node + 1]
            if i:  # the label's first character was read on the way here
                at += 1
            while at < end:  # within a label only one character can follow
                c = blob[at]
                own = word[i] if i < n else ""
                if c != own:
                    if own and (found := rest(node, at + 1, word, i + 1)) >= 0:
                        yield word[:i] + c + word[i + 1 :], count[found]
                    if (found := rest(node, at + 1, word, i)) >= 0:
                        yield word[:i] + c + word[i:], count[found]
                if own and (i + 1 == n or word[i + 1] != own) and (found := rest(node, at, word, i + 1)) >= 0:
                    yield word[:i] + word[i + 1 :], count[found]
                if c != own:
                    return
                at, i = at + 1, i + 1
            low, high = child[node], child[node + 1]
            if i == n:
                for k in range(low, high):
                    if count[k] and start[k + 1] - start[k] == 1:
                        yield word + heads[k], count[k]
                return
            own, after, last = word[i], word[i + 1 : i + 2], i + 1 == n
            # of equal characters in a row the last is the one that is left out, and one is put in behind them
            if (last or after != own) and (found := rest(node, end, word, i + 1)) >= 0:
                yield word[:i] + word[i + 1 :], count[found]
            for k in range(low, high):
                c = heads[k]
                if c == own:
                    continue
                at = start[k] + 1
                if at < start[k + 1]:  # most paths end here: look one character ahead
                    follows = blob[at]
                    replaced, put_in = follows == after, follows == own
                else:
                    replaced = put_in = True
                if replaced and (found := rest(k, at, word, i + 1)) >= 0:
                    yield word[:i] + c + word[i + 1 :], count[found]
                if put_in and (found := rest(k, at, word, i)) >= 0:
                    yield word[:i] + c + word[i:], count[found]
            node = heads.find(own, low, high)
            if node < 0:
                return
            i += 1


def _tries(most: int):
    """mapInArrow: (word, n) of a range -> its tries, of ``most`` words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []

        def built(part: list[tuple[str, int]]) -> pa.RecordBatch:
            words, counts = zip(*sorted(part))
            parts = Trie.of(list(words), list(counts)).dumped()
            return pa.RecordBatch.from_arrays([pa.array([words[0]]), pa.array([sum(map(len, parts))], pa.int64()), pa.array([parts], pa.list_(pa.binary()))], names=["first", "size", "parts"])

        for batch in batches:
            rows += zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())
            while len(rows) >= most:
                yield built(rows[:most])
                del rows[:most]
        if rows:
            yield built(rows)

    return run


def _looked_up(tries):
    """mapInArrow: (word, n) -> (word, n_near, best_n, best) over the broadcast tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Trie.loaded(parts) for parts in tries.value]
        for batch in batches:
            words, number, best_n, best = batch.column("word").to_pylist(), [], [], []
            for word in words:
                k, top, form = 0, 0, None
                for trie in loaded:
                    for other, n in trie.near(word):
                        k += 1
                        if n > top or n == top and other < form:
                            top, form = n, other
                number.append(k)
                best_n.append(top)
                best.append(form)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(number, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"])

    return run


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n) with distinct words -> (word, n_near, best_n, best): how many words are at distance one, and of those the
    one of greatest n (of equals the first in code-point order), null without one.

    The driver holds the tries of one pass: ``pass_bytes``, or one trie of at most ``shard_words`` words.
    """
    spark = vocabulary.sparkSession
    words = vocabulary.select("word", F.col("n").cast("long").alias("n"))
    total = words.count()
    path = shared_path(spark, "near-words")
    schema = "word string, n_near long, best_n long, best string"
    with dropping_shuffles(spark):
        shards = -(-total // shard_words) or 1
        tries = checkpoint(words.repartitionByRange(shards, "word").coalesce(shards).mapInArrow(_tries(shard_words), "first string, size long, parts array<binary>"))
        sizes = [(r["first"], r["size"]) for r in tries.select("first", "size").sort("first").toLocalIterator()]
        dealt = words.repartition(-(-total // TASK_WORDS) or 1, "word")
        at, passes = 0, 0
        while at < len(sizes) or not passes:
            bound, filled = at, 0
            while bound < len(sizes) and (bound == at or filled + sizes[bound][1] <= pass_bytes):
                filled, bound = filled + sizes[bound][1], bound + 1
            inside = [first for first, _ in sizes[at:bound]]
            rows = tries.filter(F.col("first").between(inside[0], inside[-1])).collect() if inside else []
            sent = spark.sparkContext.broadcast([tuple(map(bytes, r["parts"])) for r in rows])
            dealt.mapInArrow(_looked_up(sent), schema).write.mode("append").parquet(path)
            sent.destroy()
            at, passes = bound, passes + 1
    found = spark.read.schema(schema).parquet(path)
    if passes == 1:
        return found
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best"), F.col("best_n").alias("best_n"))))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.coalesce("b.best_n", F.lit(0).cast("long")).alias("best_n"), "b.best")


def roots(forms: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, form), distinct words with a form each, no cycles -> (word, root): the last word along the forms.

    By doubling: every round halves the way to the root; chains whose counts double at each step are a few dozen long.
    """
    now = checkpoint(forms.select(F.col(word).alias("word"), F.col(form).alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = checkpoint(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(vocabulary: DataFrame, word: str = "word", n: str = "n", more_than: int = MORE_THAN) -> DataFrame:
    """A table of words with counts -> word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's ``form`` is its near
    word of greatest n (ties: the first in code-point order) if that is at least ``more_than`` (2 or more) times its own n,
    ``root`` what the forms lead to, the word itself without one. Null words and words without a positive count are left out, rows of an
    equal word are one with the sum of their counts, case and accents are what they are (fold them before), words of any
    length are whole, the empty word is near to every single character, other columns are ignored, and an empty table
    gives no rows.
    """
    shield = Shield(vocabulary)
    slim = shield.df.select(F.col(shield(word)).alias("word"), F.col(shield(n)).alias("n")).filter("word IS NOT NULL")
    slim = checkpoint(slim.groupBy("word").agg(F.sum("n").cast("long").alias("n")).filter("n > 0"))
    known = slim.withColumnRenamed("word", "_w").join(neighbours(slim), F.col("_w") == F.col("word")).drop("_w")
    takes = F.col("best_n") >= more_than * F.col("n")
    known = checkpoint(known.select("word", F.when(takes, F.col("best")).alias("form"), "n", "n_near", F.when(takes, F.col("best_n")).alias("form_n")))
    ends = roots(known.filter("form IS NOT NULL")).withColumnRenamed("word", "_w")
    out = known.join(ends, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def typed_words(key: str, text: str) -> Column:
    """The words of the registered query: runs of letters, lower-cased in A-Z; where 97 divides the CRC-32 of
    "<key>:<run>", one code point is left out. Of a null text none; with a null key nothing is left out."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    return F.explode(runs).alias("run")


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of :func:`typed_words` with at least ``min_chars`` code points and ``min_count`` occurrences."""
    each = docs.select(F.col(key).alias("_key"), typed_words(key, text)).filter(F.length("run") >= min_chars)
    each = each.select("run", F.crc32(F.concat(F.col("_key").cast("string"), F.lit(":"), F.col("run"))).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO_EVERY == 0, typo).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def op11(docs: DataFrame) -> DataFrame:
    """:func:`spelling_variants` over the words of documents, some of them misspelt on purpose."""
    return spelling_variants(word_counts(docs.select("doc_id", "text")))


_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS c FROM d WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32_sql(_BYTES)} AS h FROM r, {CRC_TABLE_SQL}),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT x.word AS a, x.n AS an, v.word AS b, v.n AS bn FROM x JOIN v ON v.word = x.cut),
near AS (SELECT a, b, bn FROM p UNION ALL SELECT b, a, an FROM p UNION ALL SELECT s.word, t.word, t.n FROM x s JOIN x t ON s.i = t.i AND s.cut = t.cut AND s.word <> t.word),
best AS (SELECT a, count(*) AS n_near, max(bn) AS top FROM near GROUP BY a),
form AS (SELECT near.a, min(near.b) AS form, any_value(top) AS form_n FROM near JOIN best ON best.a = near.a AND near.bn = top JOIN v ON v.word = near.a WHERE top >= 2 * v.n GROUP BY near.a),
chain AS (SELECT word, word AS root FROM v UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.a = chain.root),
final AS (SELECT word, root FROM chain ANTI JOIN form ON form.a = chain.root)
SELECT v.word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM v JOIN final ON final.word = v.word LEFT JOIN best ON best.a = v.word LEFT JOIN form ON form.a = v.word
"""
