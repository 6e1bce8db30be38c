"""Language identification with string kernels.

Two texts compare by the n-grams (of one to three bytes, over letters) that both hold: a blended-spectrum presence
kernel, divided by the root of the product of the texts' numbers of distinct n-grams. The Nyström method with landmark
texts of each language gives finite features, and one-versus-rest ridge regression in them a score for each language.
A kernel with a landmark is a product of presences, so landmarks, Nyström root and ridge weights are multiplied once,
into a matrix of n-grams by languages; a batch of texts becomes a presence matrix, and scores are its product with it.

The classifier is fitted on a bounded sample: of each language the rows with a letter whose hashed id is smallest,
PER_LANGUAGE of them at most, and SAMPLE of all languages together. Texts of any length take part whole: tasks send
the driver the distinct n-grams of a sampled text, not the text. The driver holds the sample's n-grams and products of
at most LANDMARKS landmarks, by runs of n-grams. Predictions read whole texts.

Nulls and edge cases: a null text or one without letters is `und` with score 0; so is every text where no labelled
row with a letter exists. Rows without a language are never learned from. Of languages with equal scores the smallest
by code point wins. Repeated rows get the same result each; an empty table gives no rows. All columns pass through;
`language` is added, in place of a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, ship, slices, texts_of, trimmed, with_struct

PER_LANGUAGE, SAMPLE, LANDMARKS, MAX_LANGUAGES, RIDGE = 400, 20_000, 2048, 256, 1e-3
#: Cells of a dense run of n-grams, and of a batch's presence matrix.
CELLS = 1 << 23
#: Bytes as numbers without a gap, as tables have a place for each n-gram: blank (all ASCII but letters), letters (lower-cased), other bytes.
LETTERS, SYMBOLS = 26, 1 + 26 + 128
FOLD = np.zeros(256, np.uint32)
FOLD[97:123] = np.arange(1, LETTERS + 1)
FOLD[65:91] = np.arange(1, LETTERS + 1)
FOLD[128:] = np.arange(LETTERS + 1, SYMBOLS)

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def codes(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams of one, two and three bytes; three spaces of numbers."""
    two = folded[:-1] * np.uint32(SYMBOLS) + folded[1:]
    three = two[:-1] * np.uint32(SYMBOLS) + folded[2:]
    return folded, two + np.uint32(SYMBOLS), three + np.uint32(SYMBOLS + SYMBOLS**2)


TOP = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
BLANK = np.array([0, SYMBOLS, SYMBOLS + SYMBOLS**2])


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray  # n-grams by languages
    bias: np.ndarray

    def table(self) -> np.ndarray:
        held = np.zeros(TOP, np.uint32)
        held[self.grams] = np.arange(1, len(self.grams) + 1)
        return held


class Presence:
    """Presence matrices of texts over a model's n-grams, scaled by the root of each text's number of distinct n-grams."""

    def __init__(self, grams: np.ndarray) -> None:
        self.table, self.n = np.zeros(TOP, np.uint32), len(grams)
        self.table[grams] = np.arange(1, len(grams) + 1)
        self.last = np.zeros(TOP, np.uint32)  # where each n-gram was met last, whichever text that was

    def of(self, texts: pa.Array):
        """(first row, matrix, whether each text has a letter) for runs of texts."""
        rows = max(1, min(128, CELLS // (self.n + 1)))
        for i, j, data, offsets in slices(texts, 1 << 19):
            folded = FOLD[data]
            got = codes(folded if len(folded) >= 3 else np.r_[folded, np.zeros(3, np.uint32)])
            for a in range(i, j, rows):
                b = min(j, a + rows)
                x = np.zeros((b - a, self.n + 1), np.float32)
                letters, distinct = np.zeros(b - a, bool), np.zeros(b - a, np.float32)
                for r in range(a, b):
                    at, end = int(offsets[r - i]), int(offsets[r - i + 1])
                    for k, all_codes in enumerate(got):
                        c = all_codes[at : max(at, end - k)]
                        if len(c):
                            x[r - a, self.table[c]] = 1
                            order = np.arange(1, len(c) + 1, dtype=np.uint32)
                            self.last[c] = order  # the last of equal ones stays
                            distinct[r - a] += np.count_nonzero(self.last[c] == order) - int(self.last[BLANK[k]] > 0)
                            self.last[BLANK[k]] = 0
                    letters[r - a] = bool(np.any((folded[at:end] > 0) & (folded[at:end] <= LETTERS))) or bool(end > at and folded[at:end].any() and any(ch.isalpha() for ch in data[at:end].tobytes().decode("utf-8", "replace")))
                x /= np.sqrt(np.maximum(distinct, 1))[:, None]
                yield a, x[:, 1:], letters


def _rows(texts: list[np.ndarray], low: int, high: int, place: np.ndarray) -> np.ndarray:
    """The scaled presence matrix of texts that are given by their n-grams, in columns low to high of all n-grams' places."""
    x = np.zeros((len(texts), high - low), np.float32)
    for row, found in zip(x, texts):
        at = place[found].astype(np.int64) - 1 - low
        row[at[(at >= 0) & (at < high - low)]] = 1
    return x / np.sqrt(np.array([max(1, len(t)) for t in texts], np.float32))[:, None]


def grams_of(text: str) -> np.ndarray:
    """The distinct n-grams of a text, but for those of blanks alone."""
    folded = FOLD[np.frombuffer(text.encode(), np.uint8)]
    found = np.unique(np.concatenate([c[: max(0, len(folded) - k)] for k, c in enumerate(codes(np.r_[folded, np.zeros(2, np.uint32)]))]))
    return found[~np.isin(found, BLANK)]


def fit(texts: list[np.ndarray], labels: list[str]) -> Model | None:
    """texts: the n-grams of the sample's texts, in an order that does not depend on the run."""
    languages = sorted(set(labels))
    if not languages:
        return None
    marks, seen, most = [], dict.fromkeys(languages, 0), max(1, min(64, LANDMARKS // len(languages)))
    for i, label in enumerate(labels):
        if seen[label] < most:
            seen[label] += 1
            marks.append(i)
    found = np.zeros(TOP, bool)
    for i in marks:
        found[texts[i]] = True
    grams = np.flatnonzero(found)
    place = np.zeros(TOP, np.uint32)
    place[grams] = np.arange(1, len(grams) + 1)
    chosen, step = [texts[i] for i in marks], max(1, CELLS // len(marks))
    runs = [(low, min(len(grams), low + step)) for low in range(0, len(grams), step)]
    kernel = np.zeros((len(texts), len(marks)))
    for low, high in runs:
        landmarks = _rows(chosen, low, high, place)
        for i in range(0, len(texts), len(marks)):
            kernel[i : i + len(marks)] += _rows(texts[i : i + len(marks)], low, high, place) @ landmarks.T
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values[-1] if len(values) and values[-1] > 0 else np.zeros(len(values), bool)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.c_[kernel @ root, np.ones(len(texts))]
    number = np.array([languages.index(label) for label in labels])
    y = np.eye(len(languages))[number]
    balance = (1 / np.bincount(number))[number][:, None] * len(labels) / len(languages)
    weights = np.linalg.solve(phi.T @ (balance * phi) + RIDGE * len(texts) * np.eye(phi.shape[1]) / len(languages), phi.T @ (balance * y))
    of_landmark = (root @ weights[:-1]).astype(np.float32)
    joined = np.concatenate([_rows(chosen, low, high, place).T @ of_landmark for low, high in runs]) if runs else np.zeros((0, len(languages)), np.float32)
    return Model(languages, grams, joined, weights[-1].astype(np.float32))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _smallest(most: int):
    """Of a task's rows, the `most` of smallest hash in each language, as n-grams."""

    def cut(held: list) -> list:
        return sorted(held, key=lambda x: x[:2])[:most]

    def run(batches):
        taken: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            texts = column(batch, "text")
            for r, (lang, h) in enumerate(zip(column(batch, "lang").to_pylist(), column(batch, "h").to_pylist())):
                held = taken.setdefault(lang, [])
                held.append((h, grams_of(texts[r].as_py()).astype(np.uint32).tobytes()))
                if len(held) >= 2 * most:
                    taken[lang] = cut(held)
        for lang, held in taken.items():
            some = cut(held)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "h": [h for h, _ in some], "grams": pa.array([g for _, g in some], pa.binary())})

    return run


def train(docs: DataFrame, usable: Column) -> Model | None:
    """Fit on the bounded sample of the rows that `usable` admits and that have a language and a letter."""
    ship(docs.sparkSession)
    rows = docs.filter(F.coalesce(usable, F.lit(True)) & F.col("lang").isNotNull() & has_letter())
    rows = rows.select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} different values of lang: no column of languages")
    most = min(PER_LANGUAGE, max(1, SAMPLE // max(1, len(counts))))
    sample: dict[str, list[tuple[int, bytes]]] = {}
    left, share = set(counts), 1.5
    while left:  # a language of which the hashes below its bound are too few is asked again with a wider one
        bound = {lang: min(2**63 - 1, -(2**63) + int(share * most / counts[lang] * 2**64)) for lang in sorted(left)}
        below = F.col("h") <= F.element_at(F.create_map(*[F.lit(x) for item in bound.items() for x in item]), F.col("lang"))
        taken: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in left}
        for r in rows.filter(F.col("lang").isin(*left) & below).mapInArrow(trimmed(_smallest(most)), "lang string, h long, grams binary").collect():
            taken[r["lang"]].append((r["h"], bytes(r["grams"])))
        done = {lang for lang in left if len(taken[lang]) >= min(most, counts[lang]) or bound[lang] == 2**63 - 1}
        sample |= {lang: sorted(taken[lang])[:most] for lang in done}
        left, share = left - done, 8 * share
    ordered = sorted((h, grams, lang) for lang, held in sample.items() for h, grams in held)
    return fit([np.frombuffer(grams, np.uint32) for _, grams, _ in ordered], [lang for _, _, lang in ordered])


def identify(spark: SparkSession, docs: DataFrame, usable: Column | None = None, into: str = "language") -> DataFrame:
    """The documents with `language` (or the name given in `into`): lang_pred and score (the winning regression, held to 0 to 1). Learns from rows that `usable` admits (all)."""
    held = spark.sparkContext.broadcast(train(docs, F.lit(True) if usable is None else usable))

    def factory():
        model = held.value
        presence = Presence(model.grams) if model else None

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch)
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for a, x, letters in presence.of(texts) if model else ():
                out = x @ model.weights + model.bias
                for r in np.flatnonzero(letters):
                    names[a + r] = model.languages[int(np.argmax(out[r]))]
                    scores[a + r] = min(1.0, max(0.0, float(out[r].max())))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return make

    return with_struct(docs, into, FIELDS, factory)
