"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a word-frequency base.

The model: embeddings of ids and places, one layer of masked self-attention, a feed-forward layer, and a softmax in
two steps (a class, then a member), to whose logits direct connections from the id before are added. It reads windows
of CONTEXT ids that overlap; each id is scored once, in the window where it has the longest context. Ids outside the
vocabulary (the most frequent of all training documents) cost the escape and their share among such ids, as counted
there (half of one more for each).

Training covers all documents that are not held out. Ids are counted, then pairs of neighbouring ids; the direct
connections are the logarithms of the pairs' smoothed rates, so that attention learns what is left over. Attention
learns by gradient: the driver fits a first model on about SEED_WINDOWS windows drawn from all of them, as a start, then
every task trains a copy of it on every window of its documents, and the copies' mean weighted by ids is the model. A
caller of train() alone may have one window in DRAW of each document (one at least); score() never does. Texts are
encoded once; counting, training and scoring read their ids.

Base: counts of all words of all training documents. A task joins about BATCH_BYTES of text into a batch, asks for
each distinct word once (by hash, dealt to partitions by hash), and the answers meet the batch's documents again.
Nothing of a single word gathers more than one row for each batch.

Nulls and edge cases: a null text counts as empty and has the end alone. A null doc_id is learned from. A very long
text is scored whole, in windows as any other. Repeated rows get the same result each and count each; ids of equal
count are taken into the vocabulary from the smallest. An empty table gives no rows; without training rows the base
is 0.5 to 0.5 and the model untrained. Other columns are not looked at.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, partitions, scratch, ship, slices, texts_of
from .encode import encoder
from .words import LOWER, SOLID, bounds, hashes, mix

CONTEXT, STRIDE, DIM, HIDDEN, CLASSES = 32, 26, 32, 32, 32
VOCABULARY = CLASSES * CLASSES  # the first two are the escape and the end
ESCAPE, END, BEGIN = 0, 1, VOCABULARY
SEED_WINDOWS, SEED_EPOCHS, DRAW = 8192, 2, 8
#: Weight, in ids, of what holds without the id before, in the rates that follow one.
PRIOR = 8.0
BATCH_BYTES, PART_BYTES = 8 << 20, 64 << 20
#: Ids that a task scores at once, and windows in a step of training.
RUN_IDS, STEP = 1 << 16, 128
#: Stands for the end of a document among word hashes.
END_WORD = np.uint64(0x5851F42D4C957F2D)


def _ones(a: np.ndarray) -> np.ndarray:
    """A column of ones: products with it add up rows faster than sum() does."""
    return np.ones((a.shape[-1], 1), a.dtype)


class Attention:
    """Weights, and the passes over them."""

    def __init__(self, known: np.ndarray, n_ids: int, seed: int = 5, counts: np.ndarray | None = None) -> None:
        """known: the ids of the vocabulary after escape and end, most frequent first; counts: of all ids, else those outside are alike."""
        draw = np.random.default_rng(seed)
        make = lambda *s, scale=1.0: (draw.standard_normal(s) * scale / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.place = np.zeros(n_ids + 1, np.int32)
        self.place[known] = np.arange(2, 2 + len(known))
        #: What an id's price differs by from log_p's, which takes escapes for a uniform choice among all ids.
        self.extra = np.zeros(n_ids, np.float32)
        if counts is not None:
            outside = self.place[:n_ids] == 0
            self.extra[outside] = np.log((counts[outside] + 0.5) / (counts[outside] + 0.5).sum() * n_ids)
        self.n_ids, self.paired, self.learned = n_ids, 0, 0  # ids and ends whose pairs were counted, and those the copies were trained on
        self.follow = np.zeros((VOCABULARY + 1, CLASSES), np.float32), np.zeros(((VOCABULARY + 1) * CLASSES, CLASSES), np.float32)
        self.w = {
            "E": make(VOCABULARY + 1, DIM, scale=4.0), "P": make(CONTEXT, DIM, scale=1.0), "Q": make(DIM, DIM), "K": make(DIM, DIM), "V": make(DIM, DIM), "O": make(DIM, DIM, scale=0.5),
            "F": make(DIM, HIDDEN), "f": np.zeros(HIDDEN, np.float32), "G": make(HIDDEN, DIM, scale=0.5),
            "A": make(DIM, CLASSES, scale=0.3), "a": np.zeros(CLASSES, np.float32), "B": make(CLASSES, DIM, CLASSES, scale=0.3), "b": np.zeros((CLASSES, CLASSES), np.float32),
        }
        self.mask = np.where(np.tri(CONTEXT, dtype=bool), 0, -1e9).astype(np.float32)

    def connect(self, pairs: np.ndarray) -> None:
        """Direct connections from counts of pairs (id before, id)."""
        self.__dict__.pop("joined", None)
        pairs = pairs.reshape(VOCABULARY + 1, CLASSES, CLASSES).astype(np.float64)
        self.paired = int(pairs.sum())
        alone = pairs.sum(axis=0)
        of_class = (alone.sum(axis=1) + 1) / (alone.sum() + CLASSES)
        of_member = (alone + 0.5) / (alone + 0.5).sum(axis=1, keepdims=True)
        classes = pairs.sum(axis=2)
        first = (classes + PRIOR * of_class) / (classes.sum(axis=1, keepdims=True) + PRIOR)
        second = (pairs + PRIOR * of_member) / (classes[:, :, None] + PRIOR)
        self.follow = np.log(first).astype(np.float32), np.log(second).astype(np.float32).reshape(-1, CLASSES)

    def windows(self, ids: np.ndarray, sizes: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and targets (windows x CONTEXT each) of documents that stand in one array; a target is -1 where it is scored elsewhere or not at all.

        Read in order, the targets are each document's ids and its end, once. keep: from the number of each window in
        all and of its document, and the documents' numbers of windows, to whether it is wanted.
        """
        lengths = sizes + 1
        total, ends = int(lengths.sum()), np.cumsum(lengths)
        begins = ends - lengths
        flat = np.full(total, END, np.int32)
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        flat[inside] = self.place[ids]
        counts = 1 + np.maximum(0, -(-(lengths - CONTEXT) // STRIDE))
        of = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        if keep is not None:
            some = keep(np.arange(len(of)), of, counts)
            of, nth = of[some], nth[some]
        at = (begins[of] + nth * STRIDE)[:, None] + np.arange(CONTEXT)
        there = at < ends[of][:, None]
        at = np.minimum(at, total - 1)
        given = np.empty(total, np.int32)
        given[1:] = flat[:-1]
        given[begins] = BEGIN
        mine = there & ((nth == 0)[:, None] | (np.arange(CONTEXT) >= CONTEXT - STRIDE))
        return np.where(there, given[at], BEGIN), np.where(mine, flat[at], -1)

    def hidden(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w, n = self.w, len(x)
        e = np.take(w["E"], x, axis=0)
        e += w["P"]
        flat = e.reshape(-1, DIM)
        qkv = (flat @ np.concatenate([w[c] for c in "QKV"], axis=1)).reshape(n, CONTEXT, 3 * DIM)
        s = qkv[:, :, :DIM] @ qkv[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
        s *= np.float32(1 / np.sqrt(DIM))
        s += self.mask
        np.minimum(s, 60, out=s)  # no overflow, and no other effect on weights that training gives
        np.exp(s, out=s)
        s /= s @ _ones(s)
        r = (s @ qkv[:, :, 2 * DIM :]).reshape(-1, DIM)
        y = flat + r @ w["O"]
        h = y @ w["F"]
        h += w["f"]
        np.maximum(h, 0, out=h)
        if keep is not None:
            keep.update(e=flat, qkv=qkv, s=s, r=r, y=y, h=h)
        return y + h @ w["G"]

    def _join(self) -> None:
        """What scoring asks of the weights again and again, worked out once: a product for queries, keys and values, and connections with their biases."""
        if hasattr(self, "joined"):
            return
        self.joined = np.concatenate([self.w["Q"] * np.float32(1 / np.sqrt(DIM)), self.w["K"], self.w["V"]], axis=1)
        self.allowed = np.tri(CONTEXT, dtype=np.float32)
        long = lambda c: max(np.linalg.norm(w_ @ self.joined[:, c * DIM : (c + 1) * DIM], axis=1).max() for w_ in (self.w["E"], self.w["P"]))
        self.tame = 4 * long(0) * long(1) < 60  # no product of a query and a key is larger
        self.first = self.follow[0] + self.w["a"]
        self.second = (self.follow[1].reshape(-1, CLASSES, CLASSES) + self.w["b"]).reshape(-1, CLASSES)

    def hidden_at(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """hidden() at some flat places alone: one product for queries, keys and values, and nothing past attention elsewhere."""
        self._join()
        w, n = self.w, len(x)
        e = np.take(w["E"], x, axis=0)
        e += w["P"]
        flat = e.reshape(-1, DIM)
        qkv = (flat @ self.joined).reshape(n, CONTEXT, 3 * DIM)
        s = qkv[:, :, :DIM] @ qkv[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
        if not self.tame:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= self.allowed
        r = (s @ qkv[:, :, 2 * DIM :]).reshape(-1, DIM)[rows]
        r /= (s @ _ones(s)).reshape(-1, 1)[rows]
        y = flat[rows]
        y += r @ w["O"]
        h = y @ w["F"]
        h += w["f"]
        h *= h > 0
        y += h @ w["G"]
        return y

    def log_p(self, z: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, given the ids before them."""
        self._join()
        w = self.w
        order = np.argsort((y // CLASSES).astype(np.uint8), kind="stable")
        z, y, before = z[order], y[order], before[order]
        kind = y // CLASSES
        cuts = np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES))]
        a = z @ w["A"]
        a += self.first[before]
        rows = np.arange(len(y))
        held = a[rows, kind]
        b = self.second[before * CLASSES + kind]
        for g in range(CLASSES):
            at = slice(cuts[g], cuts[g + 1])
            if cuts[g] < cuts[g + 1]:
                b[at] += z[at] @ w["B"][g]
        held += b[rows, y % CLASSES]
        held -= self._lse(a)
        held -= self._lse(b)
        held[y == ESCAPE] -= np.float32(np.log(self.n_ids))
        out = np.empty_like(held)
        out[order] = held
        return out

    @staticmethod
    def _lse(a: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exponentials, row by row."""
        with np.errstate(over="ignore"):
            total = (np.exp(a) @ _ones(a)).ravel()
        if not np.isfinite(total).all():  # weights out of all bounds
            most = a.max(axis=1)
            return most + np.log((np.exp(a - most[:, None]) @ _ones(a)).ravel())
        return np.log(total)

    def logs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of all targets of the windows, in order."""
        step, out = 64, []  # what 64 windows need fits in a core's cache
        for n in range(0, len(x), 4 * step):
            z, ys, xs = [], [], []
            for i in range(n, min(n + 4 * step, len(x)), step):
                rows = np.flatnonzero(y[i : i + step].ravel() >= 0)
                z.append(self.hidden_at(x[i : i + step], rows))
                ys.append(y[i : i + step].ravel()[rows])
                xs.append(x[i : i + step].ravel()[rows])
            out.append(self.log_p(np.concatenate(z), np.concatenate(ys), np.concatenate(xs)))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each document with its end."""
        logs = self.logs(*self.windows(ids, sizes)).astype(np.float64)
        extra = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.extra[ids], len(sizes)) if len(ids) else 0
        return (np.add.reduceat(logs, np.cumsum(sizes + 1) - sizes - 1) + extra) / np.log(10) if len(sizes) else np.zeros(0)

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over the targets y at the flat places `row` of the windows x."""
        w, keep = self.w, {}
        z_all = self.hidden(x, keep)
        order = np.argsort((y // CLASSES).astype(np.uint8), kind="stable")
        row, y, n = row[order], y[order], len(row)
        z, before, at = z_all[row], x.ravel()[row], np.arange(n)
        c, m = y // CLASSES, y % CLASSES
        cuts = np.r_[0, np.cumsum(np.bincount(c, minlength=CLASSES))]
        some = [(k, slice(cuts[k], cuts[k + 1])) for k in range(CLASSES) if cuts[k] < cuts[k + 1]]
        g = {"B": np.zeros_like(w["B"]), "b": np.zeros_like(w["b"]), "E": np.zeros_like(w["E"])}
        a = z @ w["A"]
        a += w["a"]
        a += self.follow[0][before]
        b = self.follow[1][before * CLASSES + c] + w["b"][c]
        for k, part in some:
            b[part] += z[part] @ w["B"][k]
        loss = 0.0
        for p, chosen in ((a, c), (b, m)):
            np.minimum(p, 60, out=p)
            np.exp(p, out=p)
            p /= p @ _ones(p)
            loss -= np.log(p[at, chosen] + 1e-30).sum()
            p[at, chosen] -= 1
            p /= n
        g["A"], g["a"] = z.T @ a, a.sum(axis=0)
        dz = a @ w["A"].T
        for k, part in some:
            g["B"][k], g["b"][k] = z[part].T @ b[part], b[part].sum(axis=0)
            dz[part] += b[part] @ w["B"][k].T
        d = np.zeros_like(z_all)
        d[row] = dz
        dh = (d @ w["G"].T) * (keep["h"] > 0)
        g["G"], g["F"], g["f"] = keep["h"].T @ d, keep["y"].T @ dh, dh.sum(axis=0)
        dy = d + dh @ w["F"].T
        g["O"] = keep["r"].T @ dy
        q, k, v = np.split(keep["qkv"], 3, axis=2)
        dr, back = (dy @ w["O"].T).reshape(q.shape), np.empty_like(keep["qkv"])
        ds = dr @ v.transpose(0, 2, 1)
        ds *= keep["s"]
        ds -= keep["s"] * (ds @ _ones(ds))
        ds *= np.float32(1 / np.sqrt(DIM))
        back[:, :, :DIM], back[:, :, DIM : 2 * DIM], back[:, :, 2 * DIM :] = ds @ k, ds.transpose(0, 2, 1) @ q, keep["s"].transpose(0, 2, 1) @ dr
        back = back.reshape(-1, 3 * DIM)
        g["Q"], g["K"], g["V"] = np.split(keep["e"].T @ back, 3, axis=1)
        de = dy + back @ np.concatenate([w[c] for c in "QKV"], axis=1).T
        g["P"] = de.reshape(-1, CONTEXT, DIM).sum(axis=0)
        by = np.argsort(x.ravel(), kind="stable")
        ids = x.ravel()[by]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["E"][ids[first]] = np.add.reduceat(de[by], first, axis=0)
        return g, float(loss)

    def train(self, x: np.ndarray, y: np.ndarray, rate: float, memory: dict) -> int:
        """One pass of Adam over the windows in an order that is drawn; the number of targets."""
        self.__dict__.pop("joined", None)
        order = np.random.default_rng(11).permutation(len(x))
        for i in range(0, len(order), STEP):
            some = order[i : i + STEP]
            target = y[some].ravel()
            row = np.flatnonzero(target >= 0)
            g, _ = self.gradient(x[some], row, target[row])
            memory["t"] = t = memory.get("t", 0) + 1
            for name, v in g.items():
                first, second = memory.setdefault(name, (np.zeros_like(v), np.zeros_like(v)))
                first += np.float32(0.1) * (v - first)
                second += np.float32(0.01) * (v * v - second)
                self.w[name] -= np.float32(rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)) * first / (np.sqrt(second) + np.float32(1e-8))
        return int((y >= 0).sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        self.__dict__.pop("joined", None)
        at = 0
        for name, v in self.w.items():
            self.w[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _draw(number: int, at: np.ndarray) -> np.ndarray:
    """A hash of a batch's number and places in it."""
    return mix(at.astype(np.uint64) + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)))


def _drawn(number: int, rate: int):
    """One window in `rate` of a batch's documents, and of each document one at least."""

    def keep(window: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        some = _draw(number, window) % np.uint64(rate) == 0
        one = np.cumsum(counts) - counts + (_draw(number + 1, np.arange(len(counts))) % counts.astype(np.uint64)).astype(np.int64)
        some[one] = True
        return some

    return keep


def _summed(rows: DataFrame, blocks: int) -> np.ndarray:
    """The sum of the tasks' vectors, which come as rows (block, salt, v); by salts first, so that a task reads a part of them."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table["v"]:
            one = _unpacked(v.as_buffer().to_pybytes(), np.float64)
            total = one.copy() if total is None else total + one
        return pa.table({"block": table["block"][:1], "v": pa.array([_packed(total)], pa.binary())})

    some = rows.groupBy("block", "salt").applyInArrow(add, "block int, v binary")
    got = some.groupBy("block").applyInArrow(add, "block int, v binary").toArrow()
    held = {b: _unpacked(v, np.float64) for b, v in zip(got["block"].to_pylist(), got["v"].to_pylist())}
    return np.concatenate([held[b] for b in range(blocks)]) if held else np.zeros(0)


def _vector(v: np.ndarray, blocks: int) -> pa.RecordBatch:
    salt = TaskContext.get().partitionId() % 16
    return pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "salt": pa.array([salt] * blocks, pa.int32()), "v": pa.array([_packed(x) for x in np.array_split(v, blocks)], pa.binary())})


_VECTOR = "block int, salt int, v binary"


def train(spark: SparkSession, encoded: DataFrame, n_ids: int, draw: int | None = None) -> Attention:
    """The model of the documents that are not held out; encoded: batch, ids, sizes and held of all documents, by batches.

    draw: the copies learn from one window in so many, 1 is all of them; unset, DRAW.
    """
    draw = DRAW if draw is None else draw

    def tally(batches):
        total = np.zeros(n_ids, np.int64)
        for number, ids, sizes in _learned(batches):
            total += np.bincount(ids, minlength=n_ids)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": found.astype(np.int32), "n": total[found]})

    seen = encoded.mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_ids, np.int64)
    counts[seen["id"].to_numpy()] = seen["n"].to_numpy()
    known = np.argsort(-counts, kind="stable")[: VOCABULARY - 2]
    model = Attention(known[counts[known] > 0], n_ids, counts=counts)
    place = spark.sparkContext.broadcast(model.place)

    def pairs(batches):
        total, cells = None, VOCABULARY * (VOCABULARY + 1)
        for _, ids, sizes in _learned(batches):
            ends = np.cumsum(sizes + 1)
            flat = np.full(int(ends[-1]), END, np.int64)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = place.value[ids]
            before = np.empty_like(flat)
            before[1:] = flat[:-1]
            before[ends - sizes - 1] = BEGIN
            got = np.bincount(before * VOCABULARY + flat, minlength=cells)
            total = got if total is None else total + got
        if total is not None:
            yield _vector(total.astype(np.float64), CLASSES)

    total = _summed(encoded.mapInArrow(pairs, _VECTOR), CLASSES)
    if not len(total):
        return model
    model.connect(total)
    first = spark.sparkContext.broadcast(model)
    rate = max(1, int(counts.sum()) // STRIDE // SEED_WINDOWS)

    def seeds(batches):
        for number, ids, sizes in _learned(batches):
            x, y = first.value.windows(ids, sizes, lambda window, of, n: _draw(number + 2, window) % np.uint64(rate) == 0)
            if len(x):
                yield pa.RecordBatch.from_pydict({"x": [_packed(x.astype(np.int32))], "y": [_packed(y.astype(np.int32))], "batch": pa.array([number], pa.int64())})

    drawn = encoded.mapInArrow(seeds, "x binary, y binary, batch long").orderBy("batch").toArrow()
    if len(drawn):
        x, y = (np.concatenate([_unpacked(v, np.int32) for v in drawn[c].to_pylist()]).reshape(-1, CONTEXT) for c in "xy")
        memory: dict = {}
        for epoch in range(SEED_EPOCHS):
            model.train(x, y, 0.004 / (1 + epoch), memory)
    first = spark.sparkContext.broadcast(model)

    def replica(batches):
        own, used, kept = copy.deepcopy(first.value), 0, {}  # a worker keeps the broadcast for its next task
        for number, ids, sizes in _learned(batches):
            used += own.train(*own.windows(ids, sizes, _drawn(number, draw) if draw > 1 else None), 0.001, kept)
        if used:
            yield _vector(np.r_[own.flat() * used, float(used)], 8)

    flat = _summed(encoded.mapInArrow(replica, _VECTOR), 8)
    model.load(flat[:-1] / flat[-1])
    model.learned = int(flat[-1])
    return model


_PACK = zstandard.ZstdCompressor(level=1)


def _packed(a: np.ndarray) -> bytes:
    return _PACK.compress(a.tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _documents(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch of texts, and how many each has."""
    return _unpacked(column(batch, "ids")[row].as_py(), np.uint32), _unpacked(column(batch, "sizes")[row].as_py(), np.int64)


def _learned(batches):
    """Number, ids and sizes of the documents that are not held out, by batches that have some."""
    for batch in batches:
        for row in range(len(batch)):
            ids, sizes = _documents(batch, row)
            learn = ~np.array(column(batch, "held")[row].as_py(), bool)
            if learn.any():
                yield column(batch, "batch")[row].as_py(), ids[np.repeat(learn, sizes)], sizes[learn]


def _runs(ids: np.ndarray, sizes: np.ndarray):
    """Successive documents of some RUN_IDS ids together, or one longer document."""
    ends, at = np.cumsum(sizes + 1), 0
    while at < len(sizes):
        begin = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begin + RUN_IDS, "right")))
        yield ids[begin - at : ends[end - 1] - end], sizes[at:end]
        at = end


_ROWS = "part int, batch long, words binary, counts binary, doc_ids array<long>, held array<boolean>, lengths binary, ids binary, sizes binary, places binary, parts binary"


def _batches(path: str, parts: int):
    """From documents to a row for each batch (part null) and rows of its distinct words by partition."""

    def flush(held: list, number: int):
        hashed = np.concatenate([h[0] for h in held])
        lengths = np.concatenate([h[1] for h in held])
        out = np.concatenate([h[2] for h in held])
        learned = np.repeat(~out, lengths)
        words_, inverse, n = np.unique(hashed, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words_, places = words_[order], rank[inverse]
        counts = np.bincount(places[learned], minlength=len(words_)).astype(np.uint32)
        of = (words_ % np.uint64(parts)).astype(np.uint32)
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(parts + 1))
        base = {name: None for name in ("part", "words", "counts", "doc_ids", "held", "lengths", "ids", "sizes", "places", "parts")}
        rows = [base | {"batch": number, "doc_ids": [d for h in held for d in h[3]], "held": out.tolist(), "lengths": _packed(lengths), "ids": _packed(np.concatenate([h[4] for h in held])), "sizes": _packed(np.concatenate([h[5] for h in held])), "places": _packed(places.astype(np.uint32)), "parts": _packed(of)}]
        for p in np.flatnonzero(np.diff(cuts)):
            at = by[cuts[p] : cuts[p + 1]]
            rows.append(base | {"part": int(p), "batch": number, "words": words_[at].tobytes(), "counts": _packed(counts[at])})
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def run(batches):
        own = encoder(path)
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids, out = texts_of(batch), column(batch, "doc_id").to_pylist(), np.asarray(column(batch, "held"))
            for i, j, data, offsets in slices(texts, 1 << 19):
                low = LOWER[data]
                starts, ends = bounds(low, offsets, SOLID)
                begins = np.searchsorted(starts, offsets)
                hashed = np.insert(hashes(low, starts, ends), begins[1:], END_WORD)
                held.append((hashed, np.diff(begins) + 1, out[i:j], ids[i:j], *own.encode_slice(data, offsets)))
                size += len(data) + 256 * (j - i)
                if size >= BATCH_BYTES:
                    yield flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield flush(held, number)

    return run


_SCHEMA = pa.schema([
    ("part", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("lengths", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("parts", pa.binary()),
])


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all batches of the words of one partition, for each batch in its own order; and the totals, batch null."""
    words_ = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["words"].combine_chunks()]
    counts = [_unpacked(b.as_buffer().to_pybytes(), np.uint32) for b in table["counts"].combine_chunks()]
    distinct, inverse = np.unique(np.concatenate(words_), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(w) for w in words_])[:-1]
    got = [_packed(total[at].astype(np.uint64)) for at in np.split(inverse, cuts)]
    part = table["part"][0].as_py()
    return pa.table({
        "batch": pa.array([*table["batch"].to_pylist(), None], pa.int64()), "part": pa.array([part] * (len(got) + 1), pa.int32()), "counts": pa.array([*got, None], pa.binary()),
        "n": pa.array([0] * len(got) + [int(total.sum())], pa.int64()), "v": pa.array([0] * len(got) + [int((total > 0).sum())], pa.int64()),
    })


def encode(docs: DataFrame, path: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows of all batches; and the ids of the batches' documents alone."""
    rows = scratch(docs.withColumn("held", held_out()).mapInArrow(_batches(path, parts), _ROWS), "batches")
    return rows, rows.filter("part IS NULL").select("batch", "held", "ids", "sizes")


def score(spark: SparkSession, docs: DataFrame, path: str, parts: int | None = None, attention: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; path: a tokenizers file.

    parts: into how many the distinct words are dealt; unset, so many that each holds those of some PART_BYTES of text.
    Without attention there is no model, and score is null.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts is None:
        parts = max(partitions(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    rows, encoded = encode(docs, path, parts)
    model = spark.sparkContext.broadcast(train(spark, encoded, encoder(path).n_ids, draw=1) if attention else None)

    def scores(batches):
        for batch in batches:
            for row in range(len(batch)):
                if not attention:
                    yield pa.RecordBatch.from_pydict({"batch": column(batch, "batch")[row : row + 1], "scores": pa.array([None], pa.binary())})
                    continue
                found = np.concatenate([model.value.score(*some) for some in _runs(*_documents(batch, row))])
                yield pa.RecordBatch.from_pydict({"batch": column(batch, "batch")[row : row + 1], "scores": pa.array([found.tobytes()], pa.binary())})

    scored = scratch(encoded.mapInArrow(scores, "batch long, scores binary"), "scores")
    asked = rows.filter("part IS NOT NULL").select("part", "batch", "words", "counts")
    answers = scratch(asked.groupBy("part").applyInArrow(_answer, "batch long, part int, counts binary, n long, v long"), "answers")
    totals = answers.filter("batch IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    replies = answers.filter("batch IS NOT NULL").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("replies"))
    whole = rows.filter("part IS NULL").select("batch", "doc_ids", "held", "lengths", "places", "parts").join(replies, "batch").join(scored, "batch")

    def finish(batches):
        for batch in batches:
            for row in range(len(batch)):
                at = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
                of = _unpacked(at["parts"].as_py(), np.uint32)
                counts = np.empty(len(of), np.uint64)
                counts[np.argsort(of, kind="stable")] = np.concatenate([_unpacked(r["counts"], np.uint64) for r in at["replies"].as_py()])
                logs = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                places, lengths = _unpacked(at["places"].as_py(), np.uint32), _unpacked(at["lengths"].as_py(), np.int64)
                begins = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([
                    at["doc_ids"].values, at["held"].values, pa.array(lengths), pa.array(np.add.reduceat((counts > 0)[places].astype(np.int64), begins)), pa.array(np.full(len(lengths), n, np.int64)),
                    pa.array(np.add.reduceat(logs[places], begins)), pa.array(np.frombuffer(at["scores"].as_py(), np.float64)) if attention else pa.nulls(len(lengths), pa.float64()),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return whole.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
