"""Benchmark decontamination by winnowing.

Of each text's hashed k-grams of words, the smallest in every window of w successive ones is kept as a fingerprint.
Two texts that share k + w - 1 words share the fingerprint of those words' window, so joining the fingerprints of
documents and benchmark misses no shared span of that length. A hit is extended: every full window around it is
looked up among the benchmark's windows and compared word by word. Items of fewer words than a window are one window
each, found by their own length's hash.

The benchmark's index goes to the executors in blocks of at most BLOCK_BYTES of distinct items (or one longer item);
usually one is enough. Beyond one, a filter of fixed size with all blocks' fingerprints (and short items) parts the
documents first: those that it lets through, few in a corpus, pass each block in turn and carry what was found,
written to the shared folder in between; all others are done.

Nulls and edge cases: a null or empty text (on either side) has no words and no hits. A very long text is searched
whole. Items without an id hit words as others do, and only the list of ids lacks them; items that repeat an id count
as one, items of equal text are all listed. Repeated document rows get the same result each. An empty documents table
gives no rows, an empty benchmark no hits. All columns of the documents pass through; `decon` is added, in place of a
column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, scratch, slices, texts_of, with_struct
from .words import ALNUM, grams, owner, words

K, W = 5, 9
WINDOW = K + W - 1
#: Text of the benchmark in one block: some 20 MB of index.
BLOCK_BYTES = 1_600_000
#: 64-bit words of the filter over several blocks' fingerprints, and the column in which what was found is carried.
FILTER_WORDS = 1 << 19
CARRIED = "_lodestone_decon_carried"

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.LongType())),
]


def winnow(hashed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the smallest of some window of w within their text."""
    n = len(hashed)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, of = grams(hashed, K), owner(begins)
    least = gram[: n - WINDOW + 1].copy()  # of the window that starts here
    for j in range(1, W):
        np.minimum(least, gram[j : j + len(least)], out=least)
    least[of[: n - WINDOW + 1] != of[WINDOW - 1 :]] = 0  # crosses texts
    most = np.zeros(len(gram), np.uint64)  # largest of the minima of the windows that hold this k-gram
    for j in range(W):
        np.maximum(most[j : j + len(least)], least, out=most[j : j + len(least)])
    at = np.flatnonzero(most == gram)
    at = at[of[at] == of[at + K - 1]]
    return at, gram[at]


@dataclass
class Windows:
    """Distinct windows of one length: sorted hashes, a place of each, and the items of each."""

    length: int
    hashed: np.ndarray
    place: np.ndarray
    begins: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, length: int, held: np.ndarray, at: np.ndarray, item: np.ndarray) -> Windows:
        hashed = grams(held, length, at)
        order = np.lexsort((item, hashed))
        hashed, at, item = hashed[order], at[order], item[order]
        first = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]]) if len(hashed) else np.zeros(0, np.int64)
        return cls(length, hashed[first], at[first], np.r_[first, len(hashed)], item)

    def find(self, held: np.ndarray, texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places `at` in `texts` where a window stands, and which; words are compared one by one."""
        if not len(at) or not len(self.hashed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashed = grams(texts, self.length, at)
        k = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        same = self.hashed[k] == hashed
        at, k = at[same], k[same]
        same = np.ones(len(at), bool)
        for j in range(self.length):
            same &= texts[at + j] == held[self.place[k] + j]
        return at[same], k[same]


class Index:
    """A block of the benchmark: its words' hashes, fingerprints, full windows and short items."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        self.named = np.array([i is not None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        data = pa.array(texts, pa.large_string())
        parts = [words(d, o, ALNUM) for _, _, d, o in slices(data, 1 << 40)]
        self.words, begins = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        of, sizes = owner(begins), np.diff(begins)
        at = np.arange(max(0, len(self.words) - WINDOW + 1))
        at = at[of[at] == of[at + WINDOW - 1]] if len(at) else at
        self.windows = Windows.of(WINDOW, self.words, at, of[at])
        self.prints = np.unique(winnow(self.words, begins)[1])
        self.short = []
        for length in sorted(set(sizes[(sizes > 0) & (sizes < WINDOW)].tolist())):
            which = np.flatnonzero(sizes == length)
            self.short.append((np.unique(self.words[begins[which]]), Windows.of(length, self.words, begins[which], which)))

    @staticmethod
    def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.zeros(len(values), bool)
        return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values

    def search(self, hashed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of windows found in the texts, then (text, item number) of each distinct pair."""
        of, starts, ends, texts, items = owner(begins), [], [], [], []

        def took(kind: Windows, at: np.ndarray, k: np.ndarray) -> None:
            starts.append(at)
            ends.append(at + kind.length)
            pair = np.unique(np.stack([of[at], k]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            n = kind.begins[pair[1] + 1] - kind.begins[pair[1]]
            texts.append(np.repeat(pair[0], n))
            first = np.repeat(kind.begins[pair[1]] - np.cumsum(n) + n, n)
            items.append(kind.items[first + np.arange(len(first))])

        at, prints = winnow(hashed, begins)
        at = at[self.among(prints, self.prints)]
        if len(at):
            around = np.unique((at[:, None] - np.arange(W)[None, :]).ravel())
            around = around[(around >= 0) & (around + WINDOW <= len(hashed))]
            around = around[of[around] == of[around + WINDOW - 1]]
            took(self.windows, *self.windows.find(self.words, hashed, around))
        for firsts, kind in self.short:
            at = np.flatnonzero(self.among(hashed, firsts))
            at = at[at + kind.length <= len(hashed)]
            at = at[of[at] == of[at + kind.length - 1]]
            took(kind, *kind.find(self.words, hashed, at))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(starts), cat(ends), cat(texts), cat(items)


def _searcher(index: Index, carried: bool):
    """From a batch to the four fields; `carried` adds what earlier blocks have found."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(batch)
        before = column(batch, CARRIED).to_pylist() if carried else [None] * len(texts)
        n_words, n_hit, ids, spans = [], [], [], []
        for i, j, data, offsets in slices(texts):
            hashed, begins = words(data, offsets, ALNUM)
            starts, ends, of_text, item = index.search(hashed, begins)
            delta = np.zeros(len(hashed) + 1, np.int64)
            np.add.at(delta, starts, 1)
            np.add.at(delta, ends, -1)
            for r in range(i, j):
                if before[r] and before[r]["spans"]:
                    held = np.array(before[r]["spans"], np.int64).reshape(-1, 2) + begins[r - i]
                    np.add.at(delta, held[:, 0], 1)
                    np.add.at(delta, held[:, 1], -1)
            covered = np.cumsum(delta[:-1]) > 0
            total = np.r_[0, np.cumsum(covered)]
            hit = total[begins[1:]] - total[begins[:-1]]
            order = np.argsort(of_text, kind="stable")
            cuts = np.searchsorted(of_text[order], np.arange(j - i + 1))
            for r in range(j - i):
                a, b = begins[r], begins[r + 1]
                n_words.append(int(b - a))
                n_hit.append(int(hit[r]))
                which = item[order[cuts[r] : cuts[r + 1]]]
                found = set(index.ids[which[index.named[which]]].tolist())
                found.update((before[i + r] or {}).get("item_ids") or ())
                ids.append(sorted(found))
                edge = np.flatnonzero(np.diff(np.r_[False, covered[a:b], False])) if hit[r] else np.zeros(0, np.int64)
                spans.append(edge.tolist())
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64()))]

    return make


def _blocks(items: DataFrame, most: int) -> DataFrame:
    """The distinct items with `block`: runs of items of at most `most` bytes together, or one longer item."""
    held = scratch(items.distinct().withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).withColumn("_size", F.octet_length("text").cast("long")), "items")
    within = Window.partitionBy("_task").orderBy("_at")
    tasks = held.groupBy("_task").agg(F.sum("_size").alias("_n"))
    tasks = tasks.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each task
    before = F.col("_first") + F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # An item starts a block of its own number where it would cross a multiple of half a block, so none holds more than a block.
    half = F.lit(max(1, most // 2))
    return held.join(tasks, "_task").withColumn("block", F.floor(before / half)).select("item_id", "text", "block")


def _prints(index: Index) -> np.ndarray:
    """Hashes that a document needs one of for a hit: fingerprints, and whole short items."""
    return np.unique(np.concatenate([index.prints, *[kind.hashed for _, kind in index.short]]))


def _bits(hashed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places (word, bit) in the filter for each hash."""
    return [((hashed >> np.uint64(a)) % np.uint64(FILTER_WORDS), (hashed >> np.uint64(b)) % np.uint64(64)) for a, b in ((0, 40), (21, 52))]


def _candidates(spark: SparkSession, docs: DataFrame, blocks: DataFrame, into: str) -> DataFrame:
    """The documents with what no hits give, and `through` true in it where the filter lets a document through."""

    def marked(batches):
        held, lengths = np.zeros(FILTER_WORDS, np.uint64), set()
        for batch in batches:
            index = Index([None] * len(batch), texts_of(batch).to_pylist())
            for word, bit in _bits(_prints(index)):
                np.bitwise_or.at(held, word.astype(np.int64), np.uint64(1) << bit)
            lengths |= {kind.length for _, kind in index.short}
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.r_[at, -np.array(sorted(lengths), np.int64)]), "x": pa.array(np.r_[held[at].view(np.int64), np.zeros(len(lengths), np.int64)])})

    got = blocks.select("text").mapInArrow(marked, "w long, x long").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    word, x = got["w"].to_numpy(), got["x"].to_numpy()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[word[word >= 0]] = x[word >= 0].view(np.uint64)
    held = spark.sparkContext.broadcast((bits, sorted((-word[word < 0]).tolist())))

    def factory():
        bits, lengths = held.value

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, n_words, through = texts_of(batch), [], []
            for _, _, data, offsets in slices(texts):
                hashed, begins = words(data, offsets, ALNUM)
                of = owner(begins)
                found = [winnow(hashed, begins)]
                for length in lengths:
                    at = np.arange(max(0, len(hashed) - length + 1))
                    at = at[of[at] == of[at + length - 1]] if len(at) else at
                    found.append((at, grams(hashed, length, at)))
                hit = np.zeros(len(offsets) - 1, bool)
                for at, printed in found:
                    some = np.ones(len(at), bool)
                    for w, b in _bits(printed):
                        some &= (bits[w.astype(np.int64)] >> b) & np.uint64(1) == 1
                    hit[of[at[some]]] = True
                n_words += np.diff(begins).tolist()
                through += hit.tolist()
            none = pa.array([[]] * len(texts), pa.list_(pa.int64()))
            return [pa.array(n_words, pa.int64()), pa.array([0] * len(texts), pa.int64()), none, none, pa.array(through, pa.bool_())]

        return make

    return with_struct(docs, into, [*FIELDS, T.StructField("through", T.BooleanType())], factory)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, into: str = "decon") -> DataFrame:
    """The documents with `decon` (or the name given in `into`): n_words, n_hit, item_ids (sorted), spans (start and end word of each run that is hit, in turn)."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        rows = items.distinct().collect()
        held = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))
        return with_struct(docs, into, FIELDS, lambda: _searcher(held.value, False))
    blocks = scratch(_blocks(items, block_bytes), "blocks")
    parted = scratch(_candidates(spark, docs, blocks, into), "decon")
    fields = [F.col(into)[f.name].alias(f.name) for f in FIELDS]
    same = lambda flag: parted.filter(F.col(into)["through"] == flag).withColumn(into, F.struct(*fields))
    out = same(True)
    for b in [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()]:
        rows = blocks.filter(F.col("block") == b).collect()
        held = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found = with_struct(out.withColumnRenamed(into, CARRIED), into, FIELDS, lambda held=held: _searcher(held.value, True))
        out = scratch(found.drop(CARRIED), "decon")
    return out.unionByName(same(False))


def contaminated(found: str = "decon") -> Column:
    """A twentieth of the words or more are inside windows of the benchmark."""
    return (F.col(found)["n_hit"] > 0) & (20 * F.col(found)["n_hit"] >= F.col(found)["n_words"])


def items_digest() -> Column:
    """Lowercase hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform("decon.item_ids", lambda x: x.cast("string"))), ","), 256)

