"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every text becomes its set of hashed word shingles. Equal sets are one node. SuperMinHash gives a set M slots: each
   element goes to the slots in an order of its own and with ranks that grow by one a step, so that an element's ranks
   are correlated and the estimate varies less; once no slot can get lower, the rest of the steps are left out.
2. Slots in BANDS bands of ROWS; nodes that agree in a band share a bucket. At a similarity of 0.8 a pair shares none
   with a probability of 5e-6. Each node of a bucket is compared with the bucket's smallest by signature. Where some
   differ from it, those are compared with all of the bucket, in blocks of bounded size. Pairs whose signatures agree
   to at least the threshold less SLACK (over five standard deviations) join a family; most families are tiny.
3. Links are verified exactly on full sets. A family within one block comes together, and all its pairs not yet
   connected are verified. In a larger one the pairs that made it a family are verified first; what they leave apart
   from its largest connected part is then verified against all of the family, in pairs of blocks. Only a spanning
   forest of the true links is written.
4. Links meet in components: contracted to stars within a family or a batch, then, up to GATHERED links, all in one
   task; beyond them by alternating large-star and small-star steps in tables, as long as they are not stars and not
   few enough. Copies need no pairs: they have one node. Neither links nor components nor signatures come to the driver;
   a filter sized by the number of nodes does, up to FILTERED nodes, and beyond them a join takes its place.

Rows of a bucket, a hub or a family meet its counts by the key and a salt, so that none of them is one task's.

Nulls and edge cases: texts without words (null, empty, blank) have no shingles and are linked with nothing, their
component is their own doc_id. Fewer words than a shingle are one shingle. A very long text is one set, whole. A null
doc_id does not count as smallest where its component has another, and is null where it has none. Repeated rows are
copies. Sets whose 64-bit hashes agree but whose 128-bit hashes do not are different nodes. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, drop_scratch, join_copies, scratch, ship, slices, text_key, texts_of, trimmed
from .words import LOWER, SOLID, bounds, grams, hashes, mix

BANDS, ROWS = 40, 6
M = BANDS * ROWS
SLACK = 0.15
#: Nodes in a block of a large bucket, and nodes or bytes of sets in a block of a large family.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_BYTES = 1024, 1024, 32 << 20
#: Elements whose ranks are drawn at a time.
CHUNK = 1 << 15
#: Up to so many nodes in families a filter (two bytes a node, 64 MB at most) goes to the executors; beyond, a join.
FILTERED = 1 << 25
#: Up to so many contracted links (16 MB) meet in one task; beyond, rounds of many stages contract them.
GATHERED = 1 << 20
SALTS = 64
#: Where a node's bits choose a word and a bit of it, twice.
FILTER_BITS = ((0, 40), (20, 46))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWER[data]
    starts, ends = bounds(low, offsets, SOLID)
    hashed, begins = hashes(low, starts, ends), np.searchsorted(starts, offsets)
    gram = grams(hashed, k)
    out = []
    for a, b in zip(begins[:-1], begins[1:]):
        out.append(np.unique(gram[a : b - k + 1]) if b - a >= k else grams(hashed, int(b - a), np.array([a])) if b > a else gram[:0])
    return out


def superminhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """Signatures of 16 bits a slot, a row for each set (rows of empty sets mean nothing)."""
    n = len(sets)
    slots = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    rows = slots.reshape(n, m)
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(n), [len(s) for s in sets])
    for at in range(0, len(elements), CHUNK):
        element, own = elements[at : at + CHUNK], owners[at : at + CHUNK]
        order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1)).ravel()
        base = np.arange(len(element)) * m
        for j in range(m):
            drawn = mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            k = base + j + (((drawn >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            slot = order[k]
            order[k] = order[base + j]
            np.minimum.at(slots, own * m + slot, (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
            low, high = own[0], own[-1] + 1
            done = rows[low:high].max(axis=1) < np.uint64((j + 1) << 32)
            if done.any():
                left = ~done[own - low]
                element, own, base = element[left], own[left], base[left]
                if not len(element):
                    break
    return (mix(rows) >> np.uint64(48)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band, in columns."""
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        held = np.full(len(signatures), b + 1, np.uint64)
        for r in range(ROWS):
            held = mix(held * np.uint64(0x9E3779B97F4A7C15) + signatures[:, b * ROWS + r])
        keys[:, b] = held
    return keys.view(np.int64)


def _nodes(sets: list[np.ndarray], clash: set[int] = frozenset()) -> list[tuple[int, int] | tuple[None, None]]:
    """The two halves of each set's hash; the first of those in `clash`, which different sets share, is mixed with the second."""
    out = []
    for s in sets:
        if not len(s):
            out.append((None, None))
            continue
        node, check = struct.unpack(">qq", xxhash.xxh3_128_digest(s.tobytes()))
        out.append((node ^ check if node in clash else node, check))
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, _key (of the text), n_shingles, node and check (of the set; null if it is empty) and signature of each row."""

    def run(batches):
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "_key")
            for i, j, data, offsets in slices(texts_of(batch)):
                sets = shingle_sets(data, offsets, k)
                nodes = _nodes(sets)
                first = {}
                for r, node in enumerate(nodes):
                    if node[0] is not None:
                        first.setdefault(node, r)  # copies near one another are signed once
                signed = dict(zip(first, superminhash([sets[r] for r in first.values()])))
                held = [signed[node].tobytes() if node[0] is not None else None for node in nodes]
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], keys[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([n for n, _ in nodes], pa.int64()), pa.array([c for _, c in nodes], pa.int64()), pa.array(held, pa.binary())],
                    names=["doc_id", "_key", "n_shingles", "node", "check", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key(F.col("text")).alias("_key")).mapInArrow(trimmed(run), f"doc_id {kind}, _key binary, n_shingles long, node long, check long, signature binary")


def _signatures(values: pa.Array) -> np.ndarray:
    held = values.cast(pa.binary())
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in held), np.uint16).reshape(len(held), M)


class Forest:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up, self.parts = list(range(n)), n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.parts -= 1
        return True


def with_group(rows: DataFrame, key: str, member: str, *aggregates, least: int = 1) -> DataFrame:
    """Rows with the aggregates of their key's rows. A key's rows meet them by the key and a salt of the member, so that a hot key spreads. Keys of fewer than `least` rows go."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt"))
    groups = salted.groupBy(key).agg(*aggregates, F.bit_or(one).alias("_salts"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least).drop("_rows")
    there = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("shiftright", F.col("_salts"), i).bitwiseAND(F.lit(1)) == 1)
    groups = groups.withColumn("_salt", F.explode(there)).drop("_salts")
    return salted.join(groups, [key, "_salt"]).drop("_salt")


def _roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(a, b): each node with the smallest that it is connected with by edges between places a and b of `node`, which ascends."""
    forest = Forest(len(node))
    for x, y in zip(a.tolist(), b.tolist()):
        forest.join(x, y)
    root = np.array([forest.root(x) for x in range(len(node))], np.int64)
    up = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[up], pa.int64()), "b": pa.array(node[root[up]], pa.int64())})


def _contracted(batches):
    """The edges of each batch as stars, each around its smallest node."""
    for batch in batches:
        if len(batch):
            ends = np.concatenate([np.asarray(column(batch, "a")), np.asarray(column(batch, "b"))])
            node, at = np.unique(ends, return_inverse=True)
            yield from _roots(node, at[: len(batch)], at[len(batch) :]).to_batches()


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and the smallest that each is connected with."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, further := up[up]):
            up = further
        x, y = up[x], up[y]
        left = x != y
        x, y = x[left], y[left]
    return node, node[up]


def _ends(batches) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all batches of a task."""
    held = [(np.asarray(column(batch, "a")), np.asarray(column(batch, "b"))) for batch in batches]
    return tuple(np.concatenate([np.zeros(0, np.int64), *ends]) for ends in (zip(*held) if held else ((), ())))


def _gathered(batches):
    """(node, root) of all nodes of a task's edges."""
    node, root = _least(*_ends(batches))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _unlike_stars(batches):
    """A row if a task's edges (a > b) are not stars."""
    a, b = _ends(batches)
    node, root = _least(a, b)
    if (root[np.searchsorted(node, a)] != b).any():
        yield pa.RecordBatch.from_pydict({"a": a[:1]})


def _are_stars(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars already: no a has two b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(False).alias("down")).union(edges.select("b", F.lit(None).cast("long"), F.lit(True)))
    met = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("down").alias("down"))
    return met.filter("least <> most OR (least IS NOT NULL AND down)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the edges (a, b).

    Edges are contracted batch by batch, and up to GATHERED are then one task's. More of them go through alternating
    large-star and small-star, until what is left are stars, or few enough. That is asked before each round, by one
    aggregate: a round is many stages, whose plans and tasks the driver holds.
    """
    spent = []
    ship(edges.sparkSession)
    apart = edges.filter("a <> b").select("a", "b").mapInArrow(trimmed(_contracted), "a long, b long")
    held = scratch(apart, "edges", spent)
    while not (few := held.count() <= GATHERED) and not _are_stars(held):
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = with_group(both, "a", "b", F.least(F.min("b"), F.first("a")).alias("m"))
        large = met.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        met = with_group(large, "a", "b", F.min("b").alias("m"))
        small = met.filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(met.select("a", F.col("m").alias("b"))).distinct()
        held = scratch(small, "edges", spent)
        drop_scratch(held.sparkSession, spent, keep=1)  # a round needs the one before alone
    if few:
        one = held.coalesce(1)
        roots = one.mapInArrow(trimmed(_gathered), "node long, root long")
        return roots if one.mapInArrow(trimmed(_unlike_stars), "a long").isEmpty() else scratch(roots, "roots")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select("b", "b")).distinct()


def _families(nodes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of a forest that connects all nodes that share a bucket and whose signatures agree to `least`."""

    def exploded(batches):
        for batch in batches:
            if len(batch):
                keys = band_keys(_signatures(column(batch, "signature")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(column(batch, "node")), BANDS))], names=["bucket", "node"])

    rows = nodes.mapInArrow(trimmed(exploded), "bucket long, node long")
    members = scratch(with_group(rows, "bucket", "node", F.min("node").alias("center"), F.count(F.lit(1)).alias("n"), least=2), "buckets")
    near = scratch(nodes.join(members.select("node").distinct(), "node", "left_semi"), "near")

    def compared(batches):
        for batch in batches:
            if len(batch):
                same = (_signatures(column(batch, "signature")) == _signatures(column(batch, "other"))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(same >= least)], names=["a", "b", "ok"])

    pairs = members.filter("node <> center").select("node", "center").repartition("node").distinct()  # dealt as the join asks
    pairs = pairs.join(near, "node").join(near.select(F.col("node").alias("center"), F.col("signature").alias("other")), "center")
    pairs = scratch(pairs.select(F.col("node").alias("a"), F.col("center").alias("b"), "signature", "other").mapInArrow(trimmed(compared), "a long, b long, ok boolean"), "stars")
    edges = pairs.filter("ok").select("a", "b")
    apart = pairs.filter("NOT ok").select(F.col("a").alias("node"), F.col("b").alias("center"))
    if apart.isEmpty():
        return edges
    # The nodes apart from their bucket's center meet all others of the bucket, block by block.
    flagged = members.join(apart.withColumn("odd", F.lit(True)), ["node", "center"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    met = with_group(flagged.select("bucket", "node", "n", "odd"), "bucket", "node", F.sum(F.col("odd").cast("long")).alias("n_odd"))
    mixed = scratch(met.filter("n_odd > 0"), "odd")
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    mixed = mixed.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    sides = F.ceil(F.col("n_odd") / BUCKET_BLOCK).cast("int")
    mixed = mixed.withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), sides).cast("int"))
    base = mixed.select("bucket", "node", "odd", "block", F.explode(F.sequence(F.lit(0), sides - 1)).alias("side"), F.lit(False).alias("probe"))
    probes = mixed.filter("odd").select("bucket", "node", "odd", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "side", F.lit(True).alias("probe"))

    def connect(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, odd_, probe = (table[c].to_numpy() for c in ("node", "odd", "probe"))
        signed = _signatures(table["signature"].combine_chunks() if isinstance(table["signature"], pa.ChunkedArray) else table["signature"])
        stand, asks = np.flatnonzero(~probe), np.flatnonzero(probe)
        forest, out = Forest(len(node)), []
        plain = stand[~odd_[stand]]
        for x in plain[1:]:
            forest.join(int(plain[0]), int(x))  # all near the center
        for p in asks:
            same = (signed[stand] == signed[p]).mean(axis=1)
            for x in stand[np.flatnonzero((same >= least) & (node[stand] != node[p]))]:
                if forest.join(int(p), int(x)):
                    out.append((int(node[p]), int(node[x])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    met = base.union(probes.select(base.columns)).join(near, "node")
    return edges.union(met.groupBy("bucket", "block", "side").applyInArrow(connect, "a long, b long").distinct())


def _filter_bits(nodes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over n nodes, two bits each of some sixteen; nodes are hashes, so parts of their own bits choose."""
    size = 1 << max(10, (n // 4).bit_length())
    places = [F.struct(F.pmod(F.shiftright("node", word), F.lit(size)).alias("w"), F.pmod(F.shiftright("node", bit), F.lit(64)).cast("int").alias("bit")) for word, bit in FILTER_BITS]
    words_ = nodes.select(F.explode(F.array(*places)).alias("at")).select("at.w", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at.bit")).alias("x"))
    held = words_.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(size, np.int64)
    out[held["w"].to_numpy()] = held["x"].to_numpy()
    return out


def _admitted(nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which nodes the filter admits."""
    keep = np.ones(len(nodes), bool)
    for word, bit in FILTER_BITS:
        keep &= (bits[(nodes >> word) % len(bits)] >> ((nodes >> bit) % 64)) & 1 == 1
    return keep


def linked(sets: list[np.ndarray], threshold: float, cut: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the exact links; with `cut`, of those between the first `cut` sets and the rest."""
    n, percent = len(sets), round(threshold * 100)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    posted, first = own[order], np.r_[0, np.cumsum(sizes)]
    forest, out = Forest(n), []
    for i in range(n if cut is None else cut):
        mine = codes[first[i] : first[i + 1]]
        a, b = begins[mine], begins[mine + 1]
        length = b - a
        at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
        common = np.bincount(posted[at], minlength=n)
        good = 100 * common >= percent * (sizes[i] + sizes - common)
        good[: i + 1 if cut is None else cut] = False
        for j in np.flatnonzero(good):
            if forest.join(i, int(j)):
                out.append((i, int(j)))
        if forest.parts == 1:
            break
    return out


def _sets(members: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    held = members.combine_chunks()
    return [np.frombuffer(held[int(i)].as_buffer(), np.uint64) for i in order]


def _pairs(node: np.ndarray, order: np.ndarray, got: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([int(node[order[i]]) for i, _ in got], pa.int64()), "b": pa.array([int(node[order[j]]) for _, j in got], pa.int64())})


def _large_links(large: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Links of families beyond a block. large: family, node, members, n, blocks; edges: the pairs that made the families."""
    percent = round(threshold * 100)
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("center")).filter("node <> center").repartition("node").distinct().join(large.select("node"), "node", "left_semi")
    near = with_group(near, "center", "node", F.count(F.lit(1)).alias("degree"))
    near = near.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / FAMILY_BLOCK)).cast("int")).select("node", "center", "part")
    sets = large.select("node", "members")
    asks = near.join(sets, "node").select("center", "part", "node", "members", F.lit(False).alias("is_center"))
    centers = near.select("center", "part").distinct().join(sets.select(F.col("node").alias("center"), "members"), "center")
    centers = centers.select("center", "part", F.col("center").alias("node"), "members", F.lit(True).alias("is_center"))

    def star(table: pa.Table) -> pa.Table:
        node, order = table["node"].to_numpy(), np.argsort(~table["is_center"].to_numpy(zero_copy_only=False), kind="stable")
        held, found = _sets(table["members"], order), []
        if table["is_center"][int(order[0])].as_py():
            for k in range(1, len(held)):
                common = int(np.isin(held[k], held[0], assume_unique=True).sum())
                if 100 * common >= percent * (len(held[0]) + len(held[k]) - common):
                    found.append((0, k))
        return _pairs(node, order, found)

    dealt = asks.union(centers).repartition("center", "part")
    links = scratch(dealt.groupBy("center", "part").applyInArrow(star, "a long, b long"), "links")
    parts = large.select("family", "node", "n", "blocks").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = scratch(parts, "parts")
    sizes = parts.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    apart = scratch(largest.filter("all > k").select("family", "main", (F.col("all") - F.col("k")).alias("n_rest")), "apart")
    if apart.isEmpty():
        return links
    # What is apart from the largest part meets all of the family, block by block.
    sides = F.ceil(F.col("n_rest") / FAMILY_BLOCK).cast("int")
    spread = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = parts.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")).join(spread, ["family", "block"])
    rows = rows.withColumn("rest", F.col("root") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node", F.lit(4)), sides).cast("int")).join(sets, "node")
    base = rows.select("family", "node", "members", "block", F.explode(F.sequence(F.lit(0), sides - 1)).alias("side"), F.lit(False).alias("probe"))
    probes = rows.filter("rest").select("family", "node", "members", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "side", F.lit(True).alias("probe"))

    def rest(table: pa.Table) -> pa.Table:
        node, probe = table["node"].to_numpy(), table["probe"].to_numpy(zero_copy_only=False)
        order = np.argsort(~probe, kind="stable")
        return _pairs(node, order, linked(_sets(table["members"], order), threshold, int(probe.sum()))) if probe.any() and not probe.all() else _pairs(node, order, [])

    met = base.union(probes).repartition("family", "block", "side")
    return links.union(met.groupBy("family", "block", "side").applyInArrow(rest, "a long, b long").filter("a <> b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and _key (of the text) of each row. The smallest doc_id of a component names it."""
    ship(spark)
    held = scratch(sketch(docs, k), "sketch")
    nodes = held.filter("node IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), (F.min("check") != F.max("check")).alias("clash"))
    nodes = scratch(nodes, "nodes")
    clash = {r["node"] for r in nodes.filter("clash").select("node").collect()}  # chance hits of 64 bits, some n * n / 2**65 of n nodes
    if clash:
        mixed = F.when(F.col("node").isin(*clash), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node"))
        held = scratch(held.withColumn("node", mixed), "sketch")
        nodes = scratch(held.filter("node IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles")), "nodes")
    edges = scratch(_families(nodes.select("node", "signature"), threshold - SLACK), "edges")
    families = components(edges).withColumnRenamed("root", "family").join(nodes.select("node", "n_shingles"), "node")
    sized = with_group(families, "family", "node", F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles")).alias("size"))
    families = scratch(sized.select("family", "node", "n", F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.ceil(F.col("size") / FAMILY_BYTES)).cast("int").alias("blocks")), "families")
    n_families = families.count()
    asked = docs.select("text")
    if filtered := n_families <= FILTERED:
        bits = spark.sparkContext.broadcast(_filter_bits(families, n_families))
    else:
        keys = held.join(families.select("node"), "node", "left_semi").select("_key").distinct()
        asked = docs.select("text", text_key(F.col("text")).alias("_key")).join(keys, "_key", "left_semi").select("text")

    def sets_of(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, offsets in slices(texts_of(batch)):
                sets = shingle_sets(data, offsets, k)
                rows = {node: members for (node, _), members in zip(_nodes(sets, clash), sets) if node is not None and node not in seen}
                seen |= rows.keys()
                nodes_ = np.array(list(rows), np.int64)
                kept = nodes_[_admitted(nodes_, bits.value)].tolist() if filtered else nodes_.tolist()
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([rows[node].tobytes() for node in kept], pa.binary())], names=["node", "members"])

    found = asked.mapInArrow(trimmed(sets_of), "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))
    found = scratch(found.join(families, "node"), "members")

    def verify(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        order = np.argsort(node)
        got = np.array(linked(_sets(table["members"], order), threshold), np.int64).reshape(-1, 2)
        return _roots(node[order], got[:, 0], got[:, 1])  # stars, which need no round of components()

    links = found.filter("blocks = 1").select("family", "node", "members").groupBy("family").applyInArrow(verify, "a long, b long")
    large = found.filter("blocks > 1")
    if not large.isEmpty():
        links = links.union(_large_links(large, edges, threshold))
    roots = components(links)
    named = nodes.select("node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch(with_group(named, "root", "node", F.min("first_doc").alias("component_id")).select("node", "component_id"), "named")
    worded = held.filter("node IS NOT NULL")
    copies = worded.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    out = join_copies(worded.select("doc_id", "_key", "n_shingles", "node"), named.join(copies, "node"), "node", "_n", worded.count())
    alone = held.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_key")
    return out.select("doc_id", "n_shingles", "component_id", "_key").union(alone)


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows that name their component, with the columns they came with; of rows that repeat an id and text, one.

    Rows without a doc_id go where another of their component has one; else one of each text stays.
    """
    found = scratch(near_duplicates(spark, docs, k, threshold), "kept")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n"))
    kept = scratch(kept, "kept")
    mine = kept.select(F.col("doc_id").alias("_lodestone_doc"), F.col("_key").alias("_lodestone_same"))
    keyed = docs.withColumn("_lodestone_key", text_key(F.col("text")))
    out = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["_lodestone_doc"]) & keyed["_lodestone_key"].eqNullSafe(mine["_lodestone_same"]), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_lodestone_key"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
