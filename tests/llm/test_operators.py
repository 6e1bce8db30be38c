"""The operators against brute force, on documents with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, encode, langid, licenses, lm, media, mixing, neardup, queries, sharding, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, SOLID = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, decon string, language int, licence double, shard int, node string, slot string"


def words(text, kind=WORD):
    return kind.findall((text or "").translate(LOW))


def corpus():
    draw = np.random.default_rng(4)
    stock = {"en": ["the", "of", "house", "water", "tion", "Green"], "fr": ["le", "des", "maison", "eau", "été", "Vert"], "de": ["der", "und", "haus", "wässer", "straße", "Grün"]}
    make = lambda lang, n: " ".join(draw.choice(stock[lang]) + str(draw.choice(list("abcdefg"))) for _ in range(n)) + "."
    rows = []
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, make(lang, 5 + int(draw.integers(0, 120))), None if i % 11 == 0 else lang, f"s{i % 4}" if i % 9 else None))
    base = make("en", 150)
    for i in range(60, 75):  # near copies in a chain
        parts = base.split(" ")
        parts[i] = "changed"
        base = " ".join(parts)
        rows.append((i, base, "en", "s0"))
    rows += [(80 + i, rows[0][1], "en", "hot") for i in range(30)]  # copies
    rows += [(120, None, "en", "s1"), (121, "", "fr", None), (122, " \t\n ", None, "s1"), (123, "1234 ||| --", "de", "s2"), (124, "x" * 70_000, "en", "s2")]
    rows += [(125, make("de", 20_000), "de", "s3"), (126, "eau", None, "s3"), (126, "eau", None, "s3"), (None, "nameless text here", "en", "s1"), (None, None, None, None)]
    rows += [(127, "日本語 テキスト é́ \x1c odd\x0bspace\xa0here ａｂ", "en", "ａ"), (128, "MIT License and the Apache license; General Public LICENSE", "en", "s9"), (129, "see below: " + licenses.TEMPLATES["bsd"].upper(), "en", "s9")]
    rows += [(130, " ".join(f"bench{j}" for j in range(30)) + " tail", "en", "s1"), (131, "short item here " + rows[1][1], "en", "s1"), (132, "x\x00y <|endoftext|> z", "en", "s1")]
    return rows


BENCH = [(7, " ".join(f"bench{j}" for j in range(5, 25))), (70, "Short ITEM here"), (8, " ".join(f"bench{j}" for j in range(8, 24))), (9, None), (None, "short"), (10, ""), (11, "|| !!"), (8, "other words")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", None, 1, 2.0, 3, "n", "s") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_row(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)


def test_sharding(spark, docs, rows, empty):
    out = sharding.shard_documents(spark, docs, shards=4).collect()
    assert len(out) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == {0, 1, 2, 3}
    homes = {}
    for r in out:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    even = sharding.shard_documents(spark, docs.filter("length(text) < 2000 AND doc_id NOT BETWEEN 80 AND 109"), shards=4).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sums = [r["s"] for r in even]  # the law `bytes`: no further apart than a hundredth of a shard
    assert len(sums) == 4 and max(sums) - min(sums) <= 0.01 * max(sums)
    assert sharding.shard_documents(spark, empty, shards=4).count() == 0
    small = sharding.shard_documents(spark, docs.filter("length(text) < 2000"), capacity=60_000)
    assert all(r["s"] <= 60_000 for r in small.groupBy("shard").agg(F.sum("size").alias("s")).collect())


def test_packing_is_best_fit_decreasing():
    draw = np.random.default_rng(1)
    for _ in range(20):
        sizes = draw.integers(1, 60, 80).tolist()
        free, want = [], []
        for s in sorted(sizes, reverse=True):
            fits = [(f, i) for i, f in enumerate(free) if f >= s]
            i = min(fits)[1] if fits else len(free)
            if not fits:
                free.append(100)
            free[i] -= s
            want.append((s, i))
        got = [(s, b) for s, b, n in sharding.pack(list(Counter(sizes).items()), 100) for _ in range(n)]
        assert Counter(got) == Counter(want)  # size by size the same homes
        loads = Counter()
        for s, b in got:
            loads[b] += s
        assert max(loads.values()) <= 100


def test_decontamination(spark, docs, rows, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    items = [(i, words(t)) for i, t in BENCH if words(t)]

    def brute(text):
        w = words(text)
        hit, ids = [False] * len(w), set()
        for i, item in items:
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    ids |= {i} - {None}
                    hit[k : k + n] = [True] * n
        return len(w), sum(hit), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()

    want = sorted(((d, *brute(t)) for d, t, _, _ in rows), key=repr)
    for block_bytes in (1_600_000, 60):  # in one block and in several
        out = decontam.decontaminate(spark, docs.withColumn("_before", F.lit(1)), bench, block_bytes).select("doc_id", "decon.n_words", "decon.n_hit", decontam.items_digest().alias("sha"))
        assert by_row(out, "n_words", "n_hit", "sha") == want
    assert decontam.decontaminate(spark, empty, bench).count() == 0
    assert decontam.decontaminate(spark, docs, bench.filter("false")).filter("decon.n_hit > 0").count() == 0


def test_items_without_an_id_hit_and_are_not_listed(spark):
    passage = " ".join(f"quiz{j}" for j in range(20))
    two = spark.createDataFrame([(1, "before " + passage + " after"), (2, "an odd riddle"), (3, "named one and an odd riddle"), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "odd riddle"), (5, "named one"), (0, "absent here")], "item_id long, text string")
    for block_bytes in (1_600_000, 30):
        out = decontam.decontaminate(spark, two, bench, block_bytes).withColumn("bad", decontam.contaminated()).orderBy("doc_id").collect()
        assert [(r["decon"]["n_hit"], r["decon"]["item_ids"], r["bad"]) for r in out] == [(20, [], True), (2, [], True), (4, [5], True), (0, [], False)]


def test_winnowing_guarantee():
    draw = np.random.default_rng(2)
    for _ in range(50):
        a, b = (draw.integers(0, 2**63, 60).astype(np.uint64) for _ in range(2))
        x, y = draw.integers(0, 47, 2)
        b[y : y + 13] = a[x : x + 13]
        prints = [set(decontam.winnow(t, np.array([0, 60]))[1].tolist()) for t in (a, b)]
        assert prints[0] & prints[1]


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "lost"), (6, 1, "assistant", "yes"), (6, 0, "user", "hi"), (6, None, "system", "")]
    turns += [(None, 1, "user", "lost"), (None, 0, "user", "hi")]  # the one a copy, the other a prefix
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    out = {r["conv_id"]: (r["n_turns"], r["n_same"], r["rendered"]) for r in chat.render(df).collect()}
    assert set(out) == {2, 4, 5, 6, None}
    assert out[2] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>") and out[None] == (1, 2, "<|im_start|>user\nlost<|im_end|>")
    assert out[6][0] == 3 and out[6][2].startswith("<|im_start|>system")
    assert chat.render(df.filter("false")).count() == 0


def test_chat_against_brute_force(spark):
    """Ties in turn and role, repeated rows, nulls; prefixes by comparing lists."""
    draw = np.random.default_rng(12)
    turns = [(int(c) if c else None, None if t == 3 else int(t), [None, "user", "assistant"][r], [None, "", "a", "b", "c"][x]) for c, t, r, x in zip(draw.integers(0, 60, 260), draw.integers(0, 4, 260), draw.integers(0, 2, 260), draw.integers(0, 5, 260))]
    turns += [(100, 0, "user", "c"), (101, 0, "user", "a"), (101, 0, "user", "c")]  # no prefix in order
    lists = {}
    for n, (c, t, r, x) in enumerate(turns):
        lists.setdefault(("lone", n) if c is None else c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    lists = {c: tuple((r, x) for _, _, r, _, x in sorted(l)) for c, l in lists.items()}
    want = []
    for l in set(lists.values()):
        if not any(len(o) > len(l) and o[: len(l)] == l for o in lists.values()):
            ids = [c for c, o in lists.items() if o == l]
            named = [c for c in ids if not isinstance(c, tuple)]
            want.append((min(named, default=None), len(l), len(ids), "\n".join(f"<|im_start|>{r}\n{x}<|im_end|>" for r, x in l)))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted(map(tuple, chat.render(df).collect()), key=repr) == sorted(want, key=repr)


def test_language(spark, docs, rows, empty):
    learn = ~F.coalesce(langid.held_out(), F.lit(False))
    out = langid.identify(spark, docs, learn).select("doc_id", "text", "lang", "language.*").collect()
    assert len(out) == len(rows)
    assert {r["lang_pred"] for r in out if not any(c.isalpha() for c in r["text"] or "")} == {"und"}
    tested = [r for r in out if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 120 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.95 * len(tested) and all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(spark, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark, docs, F.lit(False)).select("language.*").collect()} == {"und"}


def test_language_learns_from_long_and_rare_usable_texts(spark):
    import corpus_pipeline

    rows_ = [(i, "der wald und die wiese " * 1000, "de") for i in range(600)]  # 23,000 characters each
    rows_ += [(1000 + i, f"the green house of water {i}", "en") for i in range(40)] + [(2000 + i, "|| 12", "en") for i in range(3000)]
    rows_ += [(None, f"la maison de mon ami {i}", "fr") for i in range(500)]
    two = spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(4)
    out = langid.identify(spark, two).filter("text NOT LIKE '||%'").select("lang", "language.lang_pred").distinct().collect()
    assert {(r["lang"], r["lang_pred"]) for r in out} == {("de", "de"), ("en", "en"), ("fr", "fr")}
    bare = spark.createDataFrame([(1, "words here", None), (2, "été", None), (3, "12 |", None), (4, None, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, bare, "").collect()} == {1, 2}


def test_all_landmark_grams_count():
    draw = np.random.default_rng(7)
    texts = ["".join(map(chr, draw.integers(lo, hi, 20_000))) for lo, hi in ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F9FF), (0x10000, 0x1FFFF))]
    grams = [langid.grams_of(t) for t in texts]
    model = langid.fit(grams, ["zh", "ko", "x", "y"])
    every = np.unique(np.concatenate(grams))
    assert len(every) > 65_535 and (model.grams == every).all() and (model.table()[every] == np.arange(1, len(every) + 1)).all()


def test_presence_is_that_of_sets():
    import pyarrow as pa

    texts = ["Abc déf", "x", "", "1 2", "aa  aa aa"]
    grams = np.arange(257, 60_000)
    (_, x, letters), = langid.Presence(grams).of(pa.array(texts, pa.large_string()))
    for row, text in zip(x, texts):
        folded = bytes(langid.FOLD[list(text.encode())].astype(np.uint8))
        every = {folded[i : i + k] for k in (1, 2, 3) for i in range(len(folded) - k + 1)} - {bytes(k) for k in (1, 2, 3)}
        assert len(every) == len(langid.grams_of(text))
        want = {256 + g[0] * 256 + g[1] for g in every if len(g) == 2} & set(grams.tolist())
        assert {int(grams[k]) for k in np.flatnonzero(row)} == want and np.allclose(row[row > 0] ** 2 * len(every), 1)
    assert letters.tolist() == [True, True, False, False, True]


def test_language_tables_have_a_place_for_each_gram_and_no_more():
    """Two tables over all n-grams in each worker: numbers of n-grams have no gaps, and different n-grams different numbers."""
    presence = langid.Presence(np.zeros(0, np.int64))
    assert presence.table.nbytes + presence.last.nbytes < 32e6
    folded = langid.FOLD[np.random.default_rng(3).integers(0, 256, 20_000)]
    got = [c[:-2] if k < 2 else c for k, c in enumerate(langid.codes(np.r_[folded, np.zeros(2, np.uint32)]))]
    whole = {(k, tuple(folded[i : i + k + 1].tolist())) for k in range(3) for i in range(len(folded) - k)}
    numbers = {(k, int(c)) for k in range(3) for c in got[k][: len(folded) - k]}
    assert len(whole) == len(numbers) == len({n for _, n in numbers}) and max(n for _, n in numbers) < langid.TOP
    last = langid.codes(np.full(3, langid.SYMBOLS - 1, np.uint32))
    assert [int(c[0]) for c in last] == [langid.BLANK[1] - 1, langid.BLANK[2] - 1, langid.TOP - 1]


def test_tasks_give_their_memory_back_once_they_hold_none(monkeypatch):
    import gc
    import weakref

    from lodestone.llm import common

    held, seen = [], []

    def run(batches):
        own = np.zeros(1000)
        held.append(weakref.ref(own))
        yield from batches

    monkeypatch.setattr(common, "_give_back", lambda: seen.append(held[0]() is None))
    assert list(common.trimmed(run)(iter([1, 2]))) == [1, 2] and seen == [True]
    monkeypatch.undo()
    gc.collect()
    assert list(common.trimmed(run)(iter([]))) == []  # and the real call does no harm


def test_language_is_plain_kernel_ridge(monkeypatch):
    """All sample texts as landmarks: the same scores as kernel ridge regression on sets, solved in the Nyström features."""
    import pyarrow as pa

    monkeypatch.setattr(langid, "CELLS", 1 << 12)  # several runs of n-grams
    draw = np.random.default_rng(9)
    stock = {"en": ["the", "house", "water", "of"], "fr": ["le", "maison", "eau", "été"], "de": ["der", "haus", "wässer", "und"]}
    labels = [["en", "fr", "de"][i % 3] for i in range(36)]
    texts = [" ".join(draw.choice(stock[lang], int(draw.integers(2, 9)))) for lang in labels]
    asked = [" ".join(draw.choice(stock[lang], 4)) for lang in ("en", "fr", "de", "en")] + ["zzz qqq", "water maison"]
    model = langid.fit([langid.grams_of(t) for t in texts], labels)
    (_, x, _), = langid.Presence(model.grams).of(pa.array(asked, pa.large_string()))
    got = x @ model.weights + model.bias

    def grams(text):
        folded = bytes(langid.FOLD[list(text.encode())].astype(np.uint8))
        return {folded[i : i + k] for k in (1, 2, 3) for i in range(len(folded) - k + 1)} - {bytes(k) for k in (1, 2, 3)}

    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    y = np.array([[label == lang for lang in sorted(stock)] for label in labels], float)
    # min over w, bias: sum of squared errors + RIDGE * n / L * (w K w + bias^2), in the dual form without features
    ridge = langid.RIDGE * len(texts) / 3
    alpha = np.linalg.solve(k + 1 + ridge * np.eye(len(texts)), y)
    want = np.array([[kernel(a, b) + 1 for b in texts] for a in asked]) @ alpha
    assert np.allclose(got, want, atol=2e-3) and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_licences(docs, rows, empty):
    def brute(text):
        w, at, base = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hits
            base |= {label} if hits else set()
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base))

    out = licenses.scan(docs).select("doc_id", "licence.*").withColumn("base", F.array_join("base_labels", ","))
    assert by_row(out, "n_words", "n_base", "first_word", "last_word", "base") == sorted(((d, *brute(t)) for d, t, _, _ in rows), key=repr)
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[129]["labels"] == ["bsd"] and found[129]["score"] == 1.0 and found[129]["spans"] == [f"bsd:2-{2 + len(licenses.TEMPLATES['bsd'].split())}"]
    assert licenses.scan(empty).count() == 0


def test_licences_of_a_file_of_notices():
    import time

    import pyarrow as pa

    def spans(text):
        return dict(zip((f.name for f in licenses.FIELDS), (a[0].as_py() for a in licenses.Scanner().batch(pa.RecordBatch.from_pydict({"text": [text]})))))["spans"]

    mit, bsd = licenses.TEMPLATES["mit"].split(), licenses.TEMPLATES["bsd"].split()
    w, want = [], []
    for i in range(20):  # some follow on directly
        for name, text in (("mit", mit), ("bsd", bsd)):
            w += ["notice", f"number{i}"] * (i % 3)
            want.append((name, len(w), len(w) + len(text)))
            w += text
    assert spans(" ".join(w)) == [f"{n}:{x}-{y}" for k in ("mit", "bsd") for n, x, y in want if n == k]
    # two damaged copies, one without its end and one without its start
    assert spans(" ".join([*mit[:120], "and", "so", "on", *mit[36:]])) == ["mit:0-120", f"mit:123-{123 + len(mit) - 36}"]
    # notices that share most of their wording
    for name in ("gpl", "lgpl", "agpl", "isc", "zlib", "unlicense", "apache", "mpl"):
        own = licenses.TEMPLATES[name].split()
        assert spans(" ".join(["x", *own, "y"])) == [f"{name}:1-{1 + len(own)}"], name
    two_clause = [*bsd[: bsd.index("neither") - 1], *bsd[bsd.index("permission") + 1 :]]
    assert [x.split(":")[0] for x in spans(" ".join(two_clause))] == ["bsd"]
    # words changed within each copy
    torn = [*bsd[:9], "odd", *bsd[10:]]
    assert spans(" ".join([*torn, "x1", *torn])) == [f"bsd:0-{len(bsd)}", f"bsd:{len(bsd) + 1}-{2 * len(bsd) + 1}"]
    began = time.time()
    assert len(spans(" ".join(mit * 700))) == 700 and time.time() - began < 30


def test_suffix_automaton_matching_statistics():
    draw, own = np.random.default_rng(5), licenses.Scanner()
    texts = [s for s in own.sequences]
    stand = {tuple(s[i:j]) for s in texts for i in range(len(s)) for j in range(i + 1, min(len(s), i + 12) + 1)}
    for _ in range(30):
        tokens_ = []
        for _ in range(6):
            s = texts[draw.integers(len(texts))]
            i = int(draw.integers(len(s)))
            tokens_ += s[i : i + int(draw.integers(1, 9))]
        found, places = own.matches(tokens_, list(range(len(tokens_))))
        size = [max((n for n in range(1, 12) if i - n + 1 >= 0 and tuple(tokens_[i - n + 1 : i + 1]) in stand), default=0) for i in range(len(tokens_))]
        want = {(i + 1, n) for i, n in enumerate(size) if n >= licenses.MIN_MATCH and n < 11 and (i + 1 == len(size) or size[i + 1] <= n)}
        assert want <= {(e, n) for e, n, _ in found}
        for start, phrase in places:
            assert tokens_[start : start + len(own.sequences[phrase])] == own.sequences[phrase]


def _png():
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media(spark, docs, rows, empty):
    out = media.measure(media.sniff(media.as_media(docs)))

    def brute(text):
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])

    got = out.select("doc_id", "n_bytes", "measured.*")
    assert by_row(got, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(((d, *brute(t)) for d, t, _, _ in rows), key=repr)
    assert all(f"declared_wrong={r['n_bytes'] % 2};" in r["feature"] for r in got.collect())
    assert all(r["media_bytes"] == r["payload_bytes"] + 44 for r in got.collect()) and media.sniff(media.as_media(empty)).count() == 0


def test_carving(spark):
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    good = [(_png(), "image/png"), (gif, "image/gif"), (jpeg, "image/jpeg"), (media.to_wav(b"1234"), "audio/wav"), (gzip.compress(b"x" * 99), "application/gzip"), (held.getvalue(), "application/zip"), (b"%PDF-1.4 ... startxref\n9\n%%EOF", "application/pdf")]
    own = media.Sniffer()
    for b, kind in good:
        assert own.sniff(b) == (kind, len(b), []) and own.sniff(b[:-1])[0] == media.UNKNOWN
        assert own.sniff(b"BM text " + b + b" RIFF GIF89a") == (media.UNKNOWN, len(b) + 20, [(8, len(b), kind)])
    df = spark.createDataFrame([(1, bytearray(_png()), "image/gif"), (2, None, "image/gif"), (3, bytearray(b""), None)], "doc_id long, media binary, declared_type string")
    assert [(r["sniffed"]["type"], r["sniffed"]["corrected"]) for r in media.sniff(df).orderBy("doc_id").collect()] == [("image/png", True), (None, False), (None, False)]


def test_sniffing_takes_linear_time():
    import time

    own = media.Sniffer()
    for piece in (b"%PDF-1.4 ", b"PK\x03\x04 ", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02 ab \xff\x00", b"PK\x03\x04PK\x05\x06" + bytes(18), b"GIF89a", b"RIFF\0\0\0\0WAVE"):
        began = time.time()
        own.sniff(b" " + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 5, piece


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix(spark, docs).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(SOLID.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    left, target, free = sum(sizes.values()), {}, list(order)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    while free:
        by = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / by > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3 * sizes[s] if over else left * weight[s] / by
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"] * r["n_rows"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 0.5 * largest[s] + 1 for s in order)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(spark, docs.repartition(5)).collect()))
    assert mixing.mix(spark, empty).count() == 0
    mixed = mixing.repeated(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] * r["n_rows"] for r in out)


def test_newton_meets_crossed_constraints(spark):
    cells = spark.createDataFrame([([0, 2], 10.0), ([0, 3], 20.0), ([1, 2], 30.0), ([1, 3], 5.0)], "ks array<int>, tokens double")
    lam = mixing.balance(cells, np.array([40.0, 25.0, 30.0, 35.0]))
    got = np.zeros(4)
    for r in cells.collect():
        got[r["ks"]] += r["tokens"] * np.exp(sum(lam[k] for k in r["ks"]))
    assert np.allclose(got, [40, 25, 30, 35], rtol=1e-6)
    with pytest.raises(ValueError):  # the first two and the last two share the same words
        mixing.balance(cells, np.array([40.0, 25.0, 30.0, 99.0]))
    many = spark.createDataFrame([([k, 3000 + k // 100], 1.0 + k % 7) for k in range(3000)], "ks array<int>, tokens double")
    want = np.array([(1.0 + k % 7) * (1 + (k % 3) / 2) for k in range(3000)])
    lam = mixing.balance(many, np.r_[want, want.reshape(-1, 100).sum(axis=1)])
    assert np.allclose([(1.0 + k % 7) * np.exp(lam[k] + lam[3000 + k // 100]) for k in range(3000)], want, rtol=1e-5)


def test_plans_beyond_broadcast_give_the_same(spark, docs, monkeypatch):
    from lodestone.llm import common

    want = [sorted(map(repr, df.collect())) for df in (sharding.shard_documents(spark, docs, shards=4), mixing.mix(spark, docs))]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BLOCK_ROWS", 2)
    assert want == [sorted(map(repr, df.collect())) for df in (sharding.shard_documents(spark, docs, shards=4), mixing.mix(spark, docs))]


def test_copies_meet_their_place_with_and_without_broadcast(spark):
    from lodestone.llm import common

    rows_ = spark.createDataFrame([("hot" if i < 1500 else f"k{i % 50}", i) for i in range(2000)], "k string, i int")
    groups = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    out = common.join_copies(rows_, groups, "k", "n", 2000).collect()
    assert len(out) == 2000 and {r["i"] for r in out} == set(range(2000)) and all(r["v"] == len(r["k"]) for r in out)


def test_token_files(spark, docs, rows, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plainly = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    order = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for d, t in order:
        ids = plainly(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.round_trip(spark, docs, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokens.round_trip(spark, empty, path).count() == 0
    import pyarrow.fs as pafs

    with open(tmp_path / "x", "wb") as f:
        held = tokens.SeekableWriter(f)
        texts = [np.arange(n, dtype=np.uint32) for n in (0, 3, 70_000, 0, 1, 66_000, 5, 0, 0)]
        for i, t in enumerate(texts):
            held.add(i, t)
        held.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        reader = tokens.SeekableReader(source)
        assert all((reader.document(i) == t).all() and len(reader.document(i)) == len(t) for i, t in enumerate(texts)) and [len(x) for x in reader.all()] == list(map(len, texts))


def test_pieces_are_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), encode.Encoder(path)
    draw = np.random.default_rng(3)
    alphabet = np.array(["a", "B", "é", "É", "'", "s", "ll", "1", " ", "\n", "!", "<", "|", ">", "×", "ß", "日", "\u0301", "\xa0", "\x0b", "Ω", "İ", "\x1c", "house", "<|endoftext|>"])
    texts = ["don't stop'll", "ÀÉÎ×÷ß ÿŸ", "İstanbul ΣΑΣ", "x<|endoftext|>y <|ENDOFTEXT|> <|", "", "  ", "ab" + "c" * 3000, "ª µ ² ½", "\x00\x7f|", "ﬁ ﬂ"]
    texts += ["".join(draw.choice(alphabet, int(draw.integers(1, 30)))) for _ in range(4000)]
    want = [got.ids for got in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.known and [x.tolist() for x in own.encode(texts)] == want
    assert [x.tolist() for x in own.encode(texts[::-1])] == want[::-1]  # from the table
    other = encode.Encoder(path)  # any other file goes the library's way
    other.tokenizer.normalizer = normalizers.NFC()
    other.known = False
    assert [x.tolist() for x in other.encode(["Ab É"])] == [other.tokenizer.encode("Ab É", add_special_tokens=False).ids]


def brute_components(rows, k, percent):
    sets = []
    for d, t, _, _ in rows:
        w = words(t, SOLID)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(root(i))) for i, (d, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, rows, k, monkeypatch):
    want = brute_components(rows, k, 80)
    assert by_row(neardup.near_duplicates(spark, docs, k), "n_shingles", "component_id") == want
    if k == 2:  # the same with tiny blocks
        monkeypatch.setattr(neardup, "FAMILY_BLOCK", 3)
        monkeypatch.setattr(neardup, "BUCKET_BLOCK", 4)
        monkeypatch.setattr(neardup, "FILTERED", 0)  # and with a join in the filter's place
        assert by_row(neardup.near_duplicates(spark, docs, k), "n_shingles", "component_id") == want


def test_large_families_lose_no_link(spark, monkeypatch):
    """Two groups that look alike without a link between them, chains, and some apart from both, in families of many blocks."""
    draw, rows_ = np.random.default_rng(21), []
    base = [f"w{i}" for i in range(60)]
    for i in range(40):
        w = list(base)
        for at in draw.choice(60, int(draw.integers(0, 13)), replace=False):
            w[at] = f"x{draw.integers(90)}"
        rows_.append((i, " ".join(w), None, None))
    want = brute_components(rows_, 1, 80)
    assert len({c for _, _, c in want}) > 1
    df = spark.createDataFrame([(d, t) for d, t, _, _ in rows_], "doc_id long, text string").repartition(3)
    for block in (4, 1024):
        monkeypatch.setattr(neardup, "FAMILY_BLOCK", block)
        assert by_row(neardup.near_duplicates(spark, df, 1), "n_shingles", "component_id") == want


def test_components_take_rounds_only_for_what_are_not_stars(spark, monkeypatch):
    """Each round is a table and many stages, whose plans and tasks the driver holds; stars and small chains need none."""
    made, scratch = [], neardup.scratch
    monkeypatch.setattr(neardup, "scratch", lambda df, name, spent=None: made.append(name) or scratch(df, name, spent))

    def found(edges, parts):
        made.clear()
        got = neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
        want = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in want:
            for a, b in edges:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        assert sorted(map(tuple, got)) == sorted(want.items())
        return len(made)

    stars = [(x, x % 7 - 9) for x in range(200)] + [(-3, -3)]
    chain = [(x, x + 1) for x in range(40)]
    assert found(stars, 5) == found(stars, 1) == found(chain, 1) == 1
    assert found([*chain, *[(1000, x) for x in range(50, 70)], (7, -1 << 62)], 8) > 1


def test_few_links_meet_without_rounds(spark, monkeypatch):
    """A round costs some thousand tasks whatever it holds; up to GATHERED links need none, and more have the same components."""
    draw, asked, are_stars = np.random.default_rng(8), [], neardup._are_stars
    monkeypatch.setattr(neardup, "_are_stars", lambda edges: asked.append(1) or are_stars(edges))
    a, b = draw.integers(-40, 40, (2, 30))
    edges = [*zip(a.tolist(), b.tolist()), *[(x, x + 1) for x in range(1000, 1006)], *[(5000, x) for x in range(2000, 2030)], (-1 << 63, (1 << 63) - 1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6).persist()
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for x, y in edges:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
    for most in (neardup.GATHERED, 40, 0):
        asked.clear()
        monkeypatch.setattr(neardup, "GATHERED", most)
        assert sorted(map(tuple, neardup.components(df).collect())) == sorted(want.items())
        assert (len(asked) > 1) == (most < 100)
    none = df.filter("a = b")
    assert neardup.components(none).count() == 0
    df.unpersist()


def test_nodes_that_share_a_hash_are_told_apart():
    sets = [np.arange(n, dtype=np.uint64) for n in (0, 1, 2, 3)]
    plain = neardup._nodes(sets)
    mixed = neardup._nodes(sets, {plain[1][0]})
    assert plain[0] == (None, None) and mixed[1] == (plain[1][0] ^ plain[1][1], plain[1][1]) and mixed[2:] == plain[2:]


def test_near_duplicates_of_nothing(spark, empty):
    assert neardup.near_duplicates(spark, empty).count() == 0


def test_deduplicate(spark, docs, rows):
    kept = neardup.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute_components(rows, 5, 80) if d == c and d is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)


def test_superminhash_estimates():
    draw = np.random.default_rng(6)
    for n, share in ((300, 0.8), (20, 0.5), (40_000, 0.3)):
        common = draw.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.concatenate([common, draw.integers(0, 2**63, n - len(common)).astype(np.uint64)]) for _ in range(2))
        true = len(common) / (2 * n - len(common))
        x = neardup.superminhash([a, b, a[:7]])
        assert abs((x[0] == x[1]).mean() - true) < 0.12
        assert (neardup.superminhash([a])[0] == x[0]).all()


def _bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_scoring(spark, docs, rows, empty):
    out = lm.score(spark, docs, _bpe())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for d, t, _, _ in rows:
        if not held(d):
            counts.update([*words(t, SOLID), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, _, _ in rows:
        w = [*words(t, SOLID), None]
        want.append((d, held(d), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = by_row(out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = lambda r: (repr(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] < 0
    assert lm.score(spark, empty, _bpe()).count() == 0


def test_model_learns_from_all_training_documents(spark, docs, rows, monkeypatch):
    two = docs.select("doc_id", "text")
    encoded = lm.encode(two, _bpe(), 4)[1]
    n_ids = encode.encoder(_bpe()).n_ids
    model = lm.train(spark, encoded, n_ids)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    learned = [t or "" for d, t, _, _ in rows if not held(d)]
    sizes = [len(x) + 1 for x in encode.encoder(_bpe()).encode(learned)]
    assert model.paired == sum(sizes)  # every pair of neighbours counts
    assert sum(min(n, lm.CONTEXT - lm.STRIDE) for n in sizes) <= model.learned < sum(sizes)  # a window of each at least
    monkeypatch.setattr(lm, "DRAW", 1)
    assert lm.train(spark, encoded, n_ids).learned == sum(sizes)


def test_scores_come_from_a_model_of_every_window(spark, docs, rows, monkeypatch):
    models, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    assert lm.score(spark, docs, _bpe()).count() == len(rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    sizes = [len(x) + 1 for x in encode.encoder(_bpe()).encode([t or "" for d, t, _, _ in rows if not held(d)])]
    assert [m.learned for m in models] == [sum(sizes)] == [m.paired for m in models]


def test_vocabulary_is_that_of_all_training_documents(spark):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    minor = next(i for i in range(50, 99) if not held(i))
    texts = {i: "the house of water " * 5 for i in range(50)} | {minor: "zebra quark " * 2500}
    two = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = encode.encoder(_bpe())
    model = lm.train(spark, lm.encode(two, _bpe(), 4)[1], own.n_ids)
    assert all(model.place[i] for i in own.encode([texts[minor]])[0])
    likely, unlikely = (model.score(own.encode([t])[0], np.array([len(own.encode([t])[0])]))[0] for t in ("zebra quark zebra quark", "zebra water zebra water"))
    assert likely > unlikely + 2
    counts = np.zeros(50_257, np.int64)
    counts[[20, 21]] = 30, 10
    few = lm.Attention(np.array([10]), 50_257, counts=counts)
    often, rarely, never = (few.score(np.array([i]), np.array([1]))[0] for i in (20, 21, 22))
    assert math.isclose(often - rarely, math.log10(30.5 / 10.5), abs_tol=1e-4) and never < rarely
    assert math.isclose(np.exp(few.extra[few.place[:-1] == 0].astype(np.float64)).sum() / 50_257, 1.0, rel_tol=1e-4)


def _model(seed=1):
    """With direct connections of some counts."""
    model = lm.Attention(np.arange(10, 10 + lm.VOCABULARY - 2), 50_257)
    model.connect(np.random.default_rng(seed).poisson(0.1, lm.VOCABULARY * (lm.VOCABULARY + 1)))
    return model


def _joined(given):
    return np.concatenate([np.zeros(0, np.int64), *given]), np.array([len(g) for g in given], np.int64)


def test_attention_gradient_and_windows():
    model = _model()
    given = [np.random.default_rng(1).integers(0, 1200, n) for n in (5, 40, 90, 0)]
    x, y = model.windows(*_joined(given))
    assert y[y >= 0].tolist() == [i for g in given for i in [*model.place[g].tolist(), lm.END]]  # each id and end once, in order
    before = x[y >= 0]
    assert (before[1:6] == model.place[given[0]]).all() and before[0] == lm.BEGIN
    model.w = {k: w.astype(np.float64) for k, w in model.w.items()}
    model.mask = model.mask.astype(np.float64)
    row = np.flatnonzero(y.ravel() >= 0)
    target = y.ravel()[row]
    g, loss = model.gradient(x, row, target)
    assert math.isclose(loss, -model.log_p(model.hidden(x)[row], target, x.ravel()[row]).sum() - (target == lm.ESCAPE).sum() * math.log(50_257), rel_tol=1e-5)
    for name, w in model.w.items():
        i = int(np.argmax(np.abs(g[name])))
        at, old = np.unravel_index(i, w.shape), w.ravel()[i]
        found = []
        for e in (1e-5, -1e-5):
            w[at] = old + e
            found.append(model.gradient(x, row, target)[1])
        w[at] = old
        assert math.isclose((found[0] - found[1]) / 2e-5 / len(target), g[name][at], rel_tol=1e-3, abs_tol=1e-9), name


def test_attention_sums_to_one():
    model = _model()
    z = model.hidden(np.full((1, lm.CONTEXT), lm.BEGIN, np.int32))[:1]
    for before in (lm.BEGIN, 7):
        p = np.exp(model.log_p(np.repeat(z, lm.VOCABULARY, axis=0), np.arange(lm.VOCABULARY), np.full(lm.VOCABULARY, before)).astype(np.float64))
        assert math.isclose(p[0] * 50_257 + p[1:].sum(), 1.0, rel_tol=1e-4)
    x = np.random.default_rng(8).integers(0, 900, (3, lm.CONTEXT))
    rows = np.array([0, 5, 31, 40, 95])
    assert np.allclose(model.hidden_at(x, rows), model.hidden(x)[rows], rtol=1e-3, atol=1e-3)


def test_attention_is_causal():
    model, draw = _model(), np.random.default_rng(3)
    given = draw.integers(10, 900, 70)
    logs = lambda ids: model.logs(*model.windows(*_joined([ids])))
    whole = logs(given)
    for at in (0, 9, 31, 32, 50, 69):
        other = given.copy()
        other[at] = 901
        got = logs(other)
        assert (got[:at] == whole[:at]).all() and got[at] != whole[at] and not np.allclose(got[at + 1 : at + 4], whole[at + 1 : at + 4], rtol=1e-6)


def test_score_is_that_of_plain_softmax_window_by_window():
    """Each id by a softmax over its row of the window's last CONTEXT inputs, written with loops."""
    model, draw = _model(), np.random.default_rng(4)
    given = [draw.integers(0, 1200, n) for n in (3, 64, 0, 33)]
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    norm = lambda a: a - np.log(np.exp(a).sum())
    want = []
    for ids in given:
        seq, total = [*model.place[ids].tolist(), lm.END], 0.0
        inputs = [lm.BEGIN, *seq[:-1]]
        for t in range(len(seq)):
            start = 0 if t < lm.CONTEXT else -(-(t + 1 - lm.CONTEXT) // lm.STRIDE) * lm.STRIDE
            e = np.array([w["E"][i] + w["P"][k] for k, i in enumerate(inputs[start : t + 1])])
            scores = (e @ w["K"]) @ (e[-1] @ w["Q"]) / math.sqrt(lm.DIM)
            v = np.exp(norm(scores)) @ (e @ w["V"])
            h = e[-1] + v @ w["O"]
            h = h + np.maximum(h @ w["F"] + w["f"], 0) @ w["G"]
            c, m = divmod(seq[t], lm.CLASSES)
            total += norm(h @ w["A"] + w["a"] + model.follow[0][inputs[t]])[c] + norm(h @ w["B"][c] + w["b"][c] + model.follow[1][inputs[t] * lm.CLASSES + c])[m]
            if seq[t] == lm.ESCAPE:
                total += model.extra[ids[t]] - math.log(50_257)
        want.append(total / math.log(10))
    assert np.allclose(model.score(*_joined(given)), want, rtol=1e-4)


def _contaminated(text):
    w, hit = words(text), set()
    for item in (words(t) for _, t in BENCH):
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        hit |= {k + j for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in windows for j in range(n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_stage_by_stage_against_brute_force(spark, tmp_path, rows):
    import corpus_pipeline

    extra = "language string, decon int, _before int, shard int, `a.b` int"
    kind = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    df = spark.createDataFrame([(*r, None, "own", 7, 8, 9, 10) for r in rows], kind)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda frame: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect()), key=repr)
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs, left = df, list(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name == names[0]:
            left = [r for r in left if r[1] and any(c.isalpha() for c in r[1])]
        elif name == names[1]:
            of = brute_components(left, 5, 80)
            least = {d: c for d, _, c in of if d is not None}
            left = [r for k, r in enumerate(left) if (r[0] is None or least[r[0]] == r[0]) and r not in left[:k]]
        elif name == names[2]:
            left = [r for r in left if not _contaminated(r[1])]
        elif name == names[3]:
            sizes, weight = Counter(), {}
            for _, t, _, s in left:
                sizes[s] += len(SOLID.findall(t))
            order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
            target = dict(zip(order, mixing.capped_targets(np.array([sizes[s] for s in order]), np.array([(1, 2, 3)[i % 3] for i in range(len(order))]), 3)))
            assert math.isclose(sum(target.values()), sum(sizes.values())) and all(target[s] <= 3 * sizes[s] for s in order)
            got = Counter(plain(docs))
            assert set(got) <= set(left) and max(got.values()) <= 3
            for s in order:
                taken = sum(n * len(SOLID.findall(r[1])) for r, n in got.items() if r[3] == s)
                assert abs(taken - target[s]) <= 0.5 * max(len(SOLID.findall(r[1])) for r in left if r[3] == s) + 1
            left = list(got.elements())
        else:
            out = docs.collect()
            assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted((r[0], len(r[1].encode()) + 1, zlib.crc32(r[1].encode())) for r in left if r[0] is not None)
            assert len(out) == len(left) and len({(r["shard"], r["slot"]) for r in out}) == len(out)
            break
        assert docs.columns == df.columns and plain(docs) == sorted(left, key=repr), name
        assert docs.filter("language <> 'own' OR decon <> 7 OR _before <> 8 OR shard <> 9 OR `a.b` <> 10").count() == 0
        docs = docs.cache()
    assert sorted(map(repr, out)) == sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_queries_have_names():
    assert {int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert json.dumps(queries.ORACLES)
