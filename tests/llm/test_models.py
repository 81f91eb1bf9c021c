"""Quality votes, language model, token store, WARC, nearest neighbours, SimHash: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import ann, lm, quality, simhash, tokenstore, warc
from loomgraph.llm.common import hash_sample, python_workers, shared_dir

from .test_native import DOCS, ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


# Quality


def prose(draw, n=60):
    return " ".join(draw.choice(["the", "house", "and", "river", "was", "green", "of", "summer"]) + draw.choice(["", "", ","]) for _ in range(n))


def junk(draw, n=60):
    return draw.choice([" | ".join(prose(draw, n).split()), "$$$ ".join(prose(draw, n).split()), prose(draw, n).upper() + "!!", "Buy " * n])


def test_quality_on_held_out_rows(spark):
    draw = random.Random(1)
    docs = [(i, junk(draw) if i % 4 == 0 else prose(draw)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)], "doc_id long, quality int")
    got = quality.digest(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_teach_nothing(spark, odd):
    docs = spark.createDataFrame([(i, prose(random.Random(i))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.digest(docs, labels)) == rows(quality.digest(docs, turned))


def test_labels_without_a_document_take_no_room_in_the_sample(spark):
    draw = random.Random(13)
    docs = spark.createDataFrame([(i, junk(draw) if i % 4 == 0 else prose(draw)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(3000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=40)
    assert len(model.labels) == 40 and set(model.labels) == {0.0, 1.0}


def test_a_repeated_id_takes_one_place_in_the_sample(spark):
    docs = [(i, f"good text {i} the river and a house" if i % 2 else f"BUY!!! {i} $$$ ###") for i in range(80)]
    taught = next(i for i in range(80) if zlib.crc32(str(i).encode()) % 5)
    many = docs + [(taught, docs[taught][1])] * 200 + [(taught, f"again {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string"
    want = quality.fit(spark.createDataFrame(docs, schema), labels, sample=50)
    got = quality.fit(spark.createDataFrame(many, schema).repartition(5), labels, sample=50)
    assert len(got.labels) == len(want.labels) == 50 and sorted(got.labels) == sorted(want.labels) and set(got.labels) == {0.0, 1.0}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.digest(odd, labels)
    assert got.count() == len(ODD) and got.where("score < 0 or score > 1 or score is null").isEmpty()
    unlabelled = quality.digest(odd, labels.limit(0))
    assert unlabelled.select("score").distinct().collect() == [(0.5,)]
    assert rows(quality.digest(none, labels)) == [] and quality.keep(odd.withColumn("score", F.lit("own")).drop("score"), labels).columns == odd.columns
    scored = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(odd, quality.fit(odd, labels)).collect()}
    assert scored[2, None] == scored[3, ""]


def test_votes_against_brute_force():
    draw = random.Random(3)
    rows_ = [quality.features(prose(draw, 5 + i % 30).encode()) for i in range(50)]
    labels = np.array([i % 2 for i in range(50)], float)
    model = quality.fit_rows(rows_, labels, rank=8)
    asked = [quality.features(junk(draw).encode()), rows_[7]]
    for (at, value), got in zip(asked, quality.votes(model, asked)):
        v = (value * model.weights[at]) @ model.basis[at]
        cosines = model.vectors @ (v / np.linalg.norm(v))
        best = np.argsort(-cosines, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[best].astype(float), 0) ** quality.POWER
        assert got == pytest.approx((weight * labels[best]).sum() / weight.sum(), abs=1e-5)


def test_quality_query_against_brute_force(spark):
    """Every document's score by the model that the query learns, from features that are counted here."""
    draw = random.Random(21)
    docs = [(i, junk(draw, 5 + i % 40) if i % 3 == 0 else prose(draw, 3 + i % 50)) for i in range(150)] + [(150, None), (151, ""), (5, "again " * 9), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 150, 2)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    want = []
    for doc_id, text in docs:
        words_ = (text or "").encode().split()
        x = np.zeros(quality.WIDTH)
        for word, n in Counter(w.lower() for w in words_).items():
            x[zlib.crc32(word) % quality.WORDS] += 1 + math.log(n)
        if words_:
            x *= quality.WORD_SHARE / math.sqrt((x**2).sum())
            shapes = np.zeros(quality.SHAPES)
            for w in words_:
                shaped = w.translate(quality.CLASSES)
                shapes[zlib.crc32(shaped[:1] + shaped[-1:]) % quality.SHAPES] += 1 / len(words_)
            x[quality.WORDS : quality.WORDS + quality.SHAPES] = np.sqrt(shapes)
            x[-2] = math.sqrt(quality.REPEAT_SHARE * sum(a == b for a, b in zip(words_, words_[1:])) / len(words_))
        x[-1] = math.sqrt(1 / (1 + len(words_) / quality.SHORT))
        v = (x * model.weights) @ model.basis.astype(float)
        cosines = model.vectors.astype(float) @ (v / np.linalg.norm(v))
        near = np.argsort(-cosines, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0) ** quality.POWER
        want.append((doc_id, zlib.crc32(str(doc_id).encode()) % 5 == 0 if doc_id is not None else True, (weight * model.labels[near]).sum() / weight.sum()))
    got = [(r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in quality.digest(frame, labels).collect()]
    assert all(p == int(s >= 0.3) for _, _, s, p in got)
    key = lambda r: (str(r[0]), round(r[2], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4)


# Language model


def model_by_hand(docs, weights):
    """(tokens, known, train tokens, base, score) per document."""
    toks = [[*words(t), None] for _, t in docs]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 if i is not None else True for i, _ in docs]
    uni, bi = Counter(), Counter()
    for t, yes in zip(toks, train):
        if yes:
            uni.update(t)
            bi.update(zip([0, *t], t))
    n, v, starts = sum(uni.values()), len(uni), sum(train)
    out = []
    for (doc_id, _), t, yes in zip(docs, toks, train):
        score = 0.0
        for u, w in zip([0, *t], t):
            cu = starts if u == 0 else uni[u]
            a = weights[int(math.log2(cu))] if cu else weights[64]
            score += math.log10(a[0] * (bi[u, w] / cu if cu else 0) + a[1] * uni[w] / max(n, 1) + a[2] / (v + 1))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((doc_id, not yes, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block", [lm.BLOCK, 200])
def test_language_model_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", 40)
    learnt = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a, **k: learnt.append(learn(*a, **k)) or learnt[-1])
    draw = random.Random(2)
    phrases = ["the river of a", "And B", "É é x", "of the river", "y rare", "a B a B"]
    docs = [(i, " ".join(draw.choice(phrases) for _ in range(draw.randrange(15)))) for i in range(150)]
    docs += [(None, "the river"), (3, "the river"), (151, None), (152, ""), (155, "unknown wörds here")]
    got = lm.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = model_by_hand(docs, learnt[0])
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    assert np.allclose(learnt[0].sum(axis=1), 1) and (learnt[0] >= 0).all()
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_levels_of_buckets_change_nothing(spark, monkeypatch):
    draw = random.Random(14)
    words_ = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choice(words_) for _ in range(draw.randrange(40)))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "BLOCK", 150)
    want = rows(lm.digest(frame))
    monkeypatch.setattr(lm, "BUCKET", 8)
    for most, fan in ((8, 2), (2, 3), (1, 1)):  # ten bits: two, four and many levels
        monkeypatch.setattr(lm, "MOST_BITS", most)
        monkeypatch.setattr(lm, "FAN_BITS", fan)
        if most == 1:
            monkeypatch.setattr(lm, "BUCKET", 400)
        assert [r[:5] for r in rows(lm.digest(frame))] == [r[:5] for r in want]
        assert [r[5:] for r in rows(lm.digest(frame))] == [pytest.approx(r[5:], abs=1e-6) for r in want]


def test_levels_merge(spark, monkeypatch):
    """Four levels: each has at most 2 * 2^FAN messages a block, and as many runs as blocks, two or three times over."""
    draw = random.Random(15)
    docs = spark.createDataFrame([(i, " ".join(f"w{draw.randrange(300)}" for _ in range(40))) for i in range(400)], "doc_id long, text string").repartition(3)
    for name, value in (("BLOCK", 130), ("MOST_BITS", 2), ("FAN_BITS", 2)):
        monkeypatch.setattr(lm, name, value)
    packed = lm.stage(lm.blocks(docs))
    units = packed.count()
    seen = []
    told = lm.told

    def watched(parts, of_space, bits, depth=0):
        seen.append((parts.count(), parts.select("unit").distinct().count(), of_space, bits))
        most = parts.groupBy("space").agg(F.countDistinct("unit").alias("n")).agg(F.max("n")).first()[0]
        assert most <= of_space
        return told(parts, of_space, bits, depth)

    monkeypatch.setattr(lm, "told", watched)
    lm.told(lm.questions(packed, lm.level(8)), units, 8).count()
    assert [bits for *_, bits in seen] == [8, 6, 4, 2] and units > 100
    assert all(rows_ <= 2 * units * 2**2 * 1.2 and runs <= 3 * units for rows_, runs, _, _ in seen), seen
    assert all(later == -(-earlier // 2**2) for (*_, earlier, _), (*_, later, _) in zip(seen, seen[1:])), seen


def test_counts_beyond_32_bits_are_whole():
    counts = np.array([0, 1, 255, 256, 5_000_000_000, 2**32, 2**62, 7])
    assert lm.unpack_counts(lm.pack_counts(counts)).tolist() == counts.tolist()
    ask = (1, 2, np.array([3, 9], np.uint64), np.array([5_000_000_000, 2**53 + 1]), np.array([0, 2**33]), None)
    again = lm.read_asked(lm.asked([ask, (2, *ask[1:])]))
    keys, known, dev, _, place = lm.merged(again)
    assert known.tolist() == [10_000_000_000, 2**54 + 2] and dev.tolist() == [0, 2**34]
    told = lm.answered(again, place, known, dev)
    assert [x.tolist() for x in lm.counts_in_order([{"told": told.column("told")[0].as_py()}])] == [known.tolist(), dev.tolist()]


def test_deleted_counts_against_the_documents(spark, monkeypatch):
    """The histogram's cells, and the weights of them, from counts of the documents by hand."""
    monkeypatch.setattr(lm, "BLOCK", 90)
    monkeypatch.setattr(lm, "BUCKET", 30)
    draw = random.Random(16)
    docs = [(i, " ".join(draw.choice(["the", "a", "of", f"r{draw.randrange(90)}"]) for _ in range(draw.randrange(20)))) for i in range(200)]
    part = lambda i: zlib.crc32(str(i).encode()) % 7
    uni, bi, starts, vocabulary = Counter(), Counter(), 0, set()
    for i, t in docs:
        toks = [*t.split(), None]
        if part(i) != 2:
            vocabulary.update(toks)
        if part(i) not in (2, 3):
            uni.update(toks)
            bi.update(zip([0, *toks], toks))
            starts += 1
    want = Counter()
    sums = Counter()
    log = lambda p: math.log2(p) if p else -999.0
    for i, t in docs:
        if part(i) == 3:
            toks = [*t.split(), None]
            for u, w in zip([0, *toks], toks):
                cu = starts if u == 0 else uni[u]
                two, one = log(bi[u, w] / cu if cu else 0), log(uni[w] / sum(uni.values()))
                cell = (int(math.log2(cu)) if cu else -1, math.floor(4 * two), math.floor(4 * one))
                want[cell] += 1
                sums[cell, "two"] += two
                sums[cell, "one"] += one
    packed, answers = lm._counted(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 0)
    cells = lm.histogram(packed, answers, sum(uni.values())).collect()
    assert {(c["bucket"], c["cell_two"], c["cell_one"]): c["n"] for c in cells} == dict(want)
    for c in cells:
        cell = c["bucket"], c["cell_two"], c["cell_one"]
        assert (c["two"], c["one"]) == (pytest.approx(sums[cell, "two"]), pytest.approx(sums[cell, "one"]))
    weights = lm.learn(cells, len(vocabulary))
    hand = lm.learn([{"bucket": b, "cell_two": x, "cell_one": y, "n": n, "two": sums[(b, x, y), "two"], "one": sums[(b, x, y), "one"]} for (b, x, y), n in want.items()], len(vocabulary))
    assert np.allclose(weights, hand, atol=1e-9) and weights[5][0] > 0


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    import xxhash as real

    class Weak:
        """A first hash that is the same for some words under the first seed."""

        @staticmethod
        def xxh64_intdigest(word, seed=0):
            return 5 if seed == 0 and word in (b"one", b"two") else real.xxh64_intdigest(word, seed)

    docs = spark.createDataFrame([(i, text) for i, text in enumerate(["one a b", "two a b", "two c", "one", "b two a"] * 6)], "doc_id long, text string").repartition(2)
    want = rows(lm.digest(docs))
    for block in (lm.BLOCK, 4):
        monkeypatch.setattr(lm, "BLOCK", block)
        with monkeypatch.context() as m:
            m.setattr(lm, "xxhash", Weak)
            tried = []
            counted = lm._counted
            m.setattr(lm, "_counted", lambda d, seed: tried.append(seed) or counted(d, seed))
            got = rows(lm.digest(docs))
            assert tried == [0, 2]
        assert [r[:5] for r in got] == [r[:5] for r in want]


def test_ids_of_the_language_model_may_be_of_any_type(spark):
    texts = ["the river of a", "And B", "of the river", "", "unknown"] * 8
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_text = rows(lm.digest(plain.withColumn("doc_id", F.col("doc_id").cast("string"))))
    assert [(int(r[0]), *r[1:]) for r in sorted(by_text, key=lambda r: int(r[0]))] == sorted(rows(lm.digest(plain)), key=lambda r: r[0])
    dated = plain.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")).alias("doc_id"), "text")
    held = {str(r["doc_id"]): r["held_out"] for r in lm.digest(dated).collect()}
    assert held == {d: zlib.crc32(d.encode()) % 7 == 2 for d in held} and len(held) == 40


def test_weights_by_expectation_maximisation():
    """Tokens drawn from a known mixture give its weights back."""
    draw = np.random.default_rng(1)
    two, one, v = draw.random(40_000), draw.random(40_000) * 0.1, 99
    cells = [{"bucket": 3, "cell_two": int(4 * math.log2(t)), "cell_one": int(4 * math.log2(o)), "n": 1, "two": math.log2(t), "one": math.log2(o)} for t, o in zip(two[:300], one[:300])]
    weights = lm.learn(cells, v)
    likelihood = lambda w: np.log(w[0] * two[:300] + w[1] * one[:300] + w[2] / 100).sum()
    assert all(likelihood(weights[3]) >= likelihood(np.array(o)) - 1e-3 for o in ([1 / 3] * 3, [0.8, 0.1, 0.1], [0.5, 0.5, 0.0]))
    assert (weights[0] == weights[3]).all() and weights[64][0] == 0


def test_language_model_of_odd_rows(odd, none):
    got = lm.digest(odd)
    assert got.count() == len(ODD) and got.where("score > 0 or isnan(score)").isEmpty()
    assert {r["n_tokens"] for r in got.where("doc_id in (2, 3, 5)").collect()} == {1}
    assert rows(lm.digest(none)) == []


# Token store


def encode_all(docs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenstore.tokenizer_path())
    return [(i, known.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs]


TEXTS = [
    (5, "Hello, World! don't 'thing it's 12345 <|endoftext|> x"), (3, None), (9, ""), (2, "H\u0331 İstanbul ΣΑΣ ﬁ e\u0301 ñ Ñandú ½ ²"), (7, "日本語 текст emoji 😀😀"), (1, "a\u00a0b\u2003c\x0bd\x1ce\x85f"),
    (4, "word " * 9000), (8, "<|STARTOFTEXT|> '' 'S 'LL 'd"), (11, "x" * 3000), (None, "null id"), (12, "same text"), (12, "same text"), (12, "more text"),
]


def test_store_round_trip(spark):
    draw = random.Random(4)
    passage = prose(draw, 1500)
    docs = TEXTS + [(100 + i, prose(draw, 300) + " " + passage + " " + prose(draw, 200)) for i in range(6)]
    root = shared_dir(spark)
    tokenstore.write(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), root)
    got = tokenstore.summary(spark, root).collect()
    want = sorted(encode_all(docs), key=lambda d: (d[0] is not None, d[0]))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in want)
    starts = sorted(r["start"] for r in got)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [i for i, _ in want]
    assert starts == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(len(ordered))]
    full = sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in tokenstore.documents(spark, root).collect())
    assert full == sorted((str(i), tuple(x)) for i, x in want)
    chunks = spark.read.parquet(f"{root}/chunks")
    refs = tokenstore.references(spark, root)
    assert chunks.count() == chunks.select("digest").distinct().count() < refs.count()
    shared = refs.groupBy("digest").count().where("count = 6").count()
    assert shared >= 2  # the middle of the passage is stored once


def test_a_changed_chunk_or_recipe_is_noticed(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    root = shared_dir(spark)
    tokenstore.write(docs, root)
    bad = shared_dir(spark)
    spark.read.parquet(f"{root}/recipes").write.parquet(f"{bad}/recipes")
    spark.read.parquet(f"{root}/chunks").withColumn("ids", F.concat("ids", F.lit(b"\1\0"))).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="isn't what its name says"):
        tokenstore.summary(spark, bad).collect()
    worse = shared_dir(spark)
    spark.read.parquet(f"{root}/chunks").write.parquet(f"{worse}/chunks")
    swapped = F.when(~F.col("total") & (F.col("place") == 2), F.concat(F.substring("digests", 1, 31), F.lit(b"x"))).otherwise(F.col("digests"))
    spark.read.parquet(f"{root}/recipes").withColumn("digests", swapped).write.parquet(f"{worse}/recipes")
    with pytest.raises(Exception, match="isn't what its root says"):
        tokenstore.summary(spark, worse).collect()
    missing = shared_dir(spark)
    spark.read.parquet(f"{root}/recipes").write.parquet(f"{missing}/recipes")
    spark.read.parquet(f"{root}/chunks").limit(3).write.parquet(f"{missing}/chunks")
    with pytest.raises(Exception, match="chunks are missing"):
        tokenstore.summary(spark, missing).collect()


def test_chunks_follow_content_not_place():
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 40_000, 20_000).astype("<u2")
    moved = np.r_[draw.integers(0, 40_000, 333).astype("<u2"), ids]
    a, b = tokenstore.cuts(ids, np.array([len(ids)]))[0], tokenstore.cuts(moved, np.array([len(moved)]))[0]
    assert len({c + 333 for c in a} & set(b)) >= len(a) - 2
    sizes = np.diff([0, *a])
    assert sizes[:-1].min() >= tokenstore.MIN and sizes.max() <= tokenstore.MAX and a[-1] == len(ids)
    assert tokenstore.cuts(ids[:7], np.array([3, 4])) == [[3], [7]]


def test_crc_of_parts():
    whole = bytes(random.Random(1).randrange(256) for _ in range(5000))
    parts, at = [], 0
    for n in (0, 1, 999, 4000):
        parts.append(whole[at : at + n])
        at += n
    after = np.array([len(whole) - sum(map(len, parts[: k + 1])) for k in range(4)])
    moved = tokenstore.shifted(np.array([zlib.crc32(p) for p in parts]), after)
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(whole)


def test_store_of_odd_rows(odd, none):
    assert tokenstore.digest(odd).count() == len(ODD) and rows(tokenstore.digest(none)) == []


# WARC

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ 4\n", ""), (5, "http://é", "ü" * 70_000), (None, "http://n", "<p>x</p>"), (7, "http://a/7", "only"), (7, "http://a/7", "only"), (8, "u", "\r\n\r\nWARC/1.1")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages):
    got = warc.digest(pages).collect()
    best = {}
    for i, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        keeper = best[html or ""]
        revisit = i != keeper
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert rows(warc.digest(pages.limit(0))) == []
    paths = [r["path"] for r in warc.write(pages, shared_dir(spark)).collect()]
    payloads = {(r["page_id"], r["record_type"]): r["payload"] for r in warc.read(spark, paths, payloads=True).collect()}
    assert bytes(payloads[5, "response"]) == ("ü" * 70_000).encode() and payloads[1, "revisit"] is None
    small = {(r["page_id"], r["record_type"]) for r in warc.read(spark, [r["path"] for r in warc.write(pages, shared_dir(spark), min_bytes=5).collect()]).collect()}
    assert (1, "revisit") in small and (3, "response") in small  # empty payloads are below the bound


def test_warc_query_against_brute_force(spark):
    draw = random.Random(22)
    pages_ = [(i, f"http://h{i % 3}/", draw.choice(["", "a", "same page", "é" * 40, None, f"own {i}"])) for i in range(90)] + [(7, "again", "same page"), (None, "x", "a"), (None, "y", "only null"), (None, "z", "only null"), (200, None, "z" * 200_000)]
    groups = {}
    for page_id, _, html in pages_:
        groups.setdefault(html or "", []).append(page_id)
    want = []
    for page_id, _, html in pages_:
        payload = (html or "").encode()
        largest = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = len(groups[html or ""]) > 1 and largest is not None and page_id != largest
        want.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    got = warc.digest(spark.createDataFrame(pages_, "page_id long, url string, html string").repartition(5))
    assert rows(got) == sorted(want, key=str)


def archive(*records, dictionary=b"the quick brown fox " * 50, packed=True):
    known = warc._dictionary(dictionary)
    frames = [zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True).compress(r) for r in records]
    head = warc.dictionary_frame(dictionary) if packed else struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    return head, frames


def test_archives_with_either_kind_of_dictionary():
    one, two = warc.record("response", 1, "http://a", b"the quick brown fox " * 400), warc.record("revisit", 2, "http://b", b"x", 1)
    for packed in (True, False):
        head, frames = archive(one, two, packed=packed)
        found = list(warc.records(head + b"".join(frames)))
        assert [r.headers["x-page-id"] for r in found] == ["1", "2"] and found[0].payload == b"the quick brown fox " * 400
        skippable = struct.pack("<II", 0x184D2A50, 3) + b"abc"
        assert len(list(warc.records(head + frames[0] + skippable + frames[1]))) == 2
    plain = zstandard.ZstdCompressor().compress(one)
    assert next(warc.records(plain)).headers["warc-type"] == "response" and list(warc.records(b"")) == []


def test_frames_are_walked_as_they_end():
    draw = random.Random(1)
    for size in (0, 1, 300, 70_000, 300_000):
        for data in (bytes(size), bytes(draw.randrange(256) for _ in range(size))):
            for checksum in (True, False):
                frame = zstandard.ZstdCompressor(write_checksum=checksum).compress(data)
                assert warc.frame_end(memoryview(b"zz" + frame + b"rest"), 2) == 2 + len(frame)


def test_broken_archives_raise():
    good = warc.record("response", 1, "http://a", b"payload")
    head, frames = archive(good)
    for broken in (
        head[:-3], head + frames[0][:-1], head + b"garbage!", head + frames[0] + b"\x28",
        *(b"".join([archive(bad)[0], *archive(bad)[1]]) for bad in (good.replace(b"payload", b"pailoud"), good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-1], good.replace(b"WARC-Date", b"X-Date"), good + b"x", good.replace(b"Content-Length: 7", b"Content-Length: 8"))),
    ):
        with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
            list(warc.records(broken))


# Nearest neighbours


def by_brute_force(vectors, queries, k=5):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in good:
            near = [(-(good[q] * v).sum() / (math.sqrt((good[q] ** 2).sum()) * math.sqrt((v * v).sum())), i) for i, v in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def test_recall_on_clusters_and_copies(spark):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((20, 32)) * 2
    vectors = [(i, (centres[i % 20] + draw.standard_normal(32)).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(3000 + i, vectors[7][1]) for i in range(1500)]  # a third are one vector
    got = {}
    for r in ann.digest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = by_brute_force(vectors, [i for i, _ in vectors if i % 50 == 0])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [i for i, _ in got[3000]] == [7, 3001, 3002, 3003, 3004]  # ties to smaller ids
    exact = {q: dict(w) for q, w in want.items()}
    assert all(s == pytest.approx(exact[q][i], abs=1e-15) for q in got for i, s in got[q] if i in exact[q])


def test_vectors_that_take_no_part(spark):
    vectors = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [float("nan"), 1.0]), (200, [1.0, float("inf")]), (250, [None, 1.0]), (1, [1.0, 1.0]), (2, [1e300, 1e300]), (None, [1.0, 2.0]), (300, [0.0, -2.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "list": F.lit(1)})
    got = rows(ann.digest(frame).select("query_id", "rank", "vec_id"))
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 300), (300, 1, 0), (300, 2, 1), (300, 3, 2)] or got == [(0, 1, 2), (0, 2, 1), (0, 3, 300), (300, 1, 0), (300, 2, 1), (300, 3, 2)]
    assert rows(ann.digest(frame.limit(0))) == []
    assert rows(ann.digest(frame.where("vec_id = 0"))) == []


def test_recall_without_clusters_from_short_lists(spark, monkeypatch):
    """No structure at all: most lists are probed, but few rows are reranked; in blocks of queries."""
    monkeypatch.setattr(ann, "QUERIES", 40)
    draw = np.random.default_rng(8)
    vectors = [(i, draw.standard_normal(32).astype(np.float32).tolist()) for i in range(6000)]
    index = ann.fit_rows(ann.unit(np.array([v for _, v in vectors])), 6000)
    assert index.shortlist <= 0.03 * 6000
    got = {}
    for r in ann.digest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = by_brute_force(vectors, [i for i, _ in vectors if i % 50 == 0])
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


@pytest.mark.parametrize("kind", ["apart", "between clusters", "one direction", "prime width"])
def test_recall_on_other_rows(spark, kind):
    """Queries unlike the rows that the sample shows, rows that nearly agree, and a width that no number of subspaces divides."""
    draw = np.random.default_rng(12)
    n, width = {"apart": (10_000, 64), "prime width": (4000, 37)}.get(kind, (4000, 32))
    x = draw.standard_normal((n, width))
    if kind == "apart":
        x[::50] = x[::50] * 0.2 + 3
    elif kind == "between clusters":
        x = draw.standard_normal((60, 32))[np.arange(4000) % 60] + 0.05 * x
        x[::50] = draw.standard_normal((80, 32))
    elif kind == "one direction":
        x = 1 + 0.001 * x
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.digest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = by_brute_force(vectors, range(0, n, 50))
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    assert ann.fit_rows(ann.unit(x), n).shortlist <= 0.1 * n


def test_clusters_are_found_with_few_probes():
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((64, 16)) * 8
    index = ann.fit_rows(ann.unit(np.array([centres[i % 64] + draw.standard_normal(16) for i in range(4096)])), 4096)
    assert index.probes <= len(index.centroids) // 4


def test_vectors_of_different_lengths_raise(spark):
    for odd in ([1.0], [1.0, 2.0, 3.0], []):
        with pytest.raises(ValueError, match="different lengths"):
            ann.digest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, odd or [1.0] * 5)], "vec_id long, embedding array<double>"))
    empty = ann.digest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [])], "vec_id long, embedding array<double>"))
    assert rows(empty.select("query_id", "vec_id")) == [(0, 1)]  # without components it is zero


def test_few_and_repeated_rows(spark):
    got = ann.digest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 1)]


def test_repeated_rows_of_a_query_answer_as_one(spark):
    vectors = [(0, [1.0, 0.0])] * 9 + [(i, [1.0, i / 10]) for i in range(1, 8)] + [(3, [1.0, 0.3])] + [(20 + i, [1.0, 0.0]) for i in range(2)]
    vectors += [(50, [0.0, 1.0]), (50, [-1.0, 0.0])]  # one id, two vectors
    got = {}
    for r in ann.digest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [20, 21, 1, 2, 3], 50: [7, 6, 5, 4, 3]}


# SimHash


def fingerprint(text, width=3):
    w = words(text)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark):
    draw = random.Random(6)
    base = [prose(draw, 400) for _ in range(5)]
    docs = [(i, prose(draw, draw.randrange(1, 30))) for i in range(80)]
    docs += [(100 + i, base[i % 5].replace("river", "lake", i % 4) + " tail" * (i % 3)) for i in range(60)]
    docs += [(300, None), (301, ""), (302, " \t"), (303, "Two words"), (304, "two WORDS"), (305, "É é")]
    marks = {i: fingerprint(t) for i, t in docs}
    roots = least(list(marks), [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 3])
    got = simhash.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert rows(got) == sorted(((i, f"{marks[i]:016x}", roots[i]) for i in marks), key=str)
    assert len(set(roots.values())) < len(set(marks.values()))  # some links are between different fingerprints


@pytest.mark.parametrize("n_words, radius, sizes, most", [(1, 3, False, 65_536), (1, 3, False, 16), (4, 51, True, 65_536), (4, 51, True, 32)])
def test_links_lose_nothing(spark, monkeypatch, n_words, radius, sizes, most):
    """Components over random and nearby fingerprints, in large and in tiny tiles."""
    monkeypatch.setattr(simhash, "TILE", most)
    monkeypatch.setattr(simhash, "MOST_TILES", 10_000)
    real = simhash.tiles_of
    monkeypatch.setattr(simhash, "tiles_of", lambda counts, wanted: real(counts, min(wanted, most)))
    draw = random.Random(8)
    bits = 64 * n_words
    marks = [draw.getrandbits(bits) for _ in range(250)]
    for _ in range(250):
        near = draw.choice(marks)
        for _ in range(draw.randrange(1, radius + 3)):
            near ^= 1 << draw.randrange(bits)
        marks.append(near)
    marks += [0, 1, (1 << bits) - 1]
    nodes = sorted({(m, draw.choice([0, 1, 4, 5, 100, 124, 125, 126, 160]) if sizes else 0) for m in marks})
    names = [m.to_bytes(8 * n_words, "big") + (n.to_bytes(8, "big") if sizes else b"") for m, n in nodes]
    fit = lambda x, y: not sizes or 5 * min(x, y) >= 4 * max(x, y)
    linked = [(names[i], names[j]) for i in range(len(nodes)) for j in range(i) if (nodes[i][0] ^ nodes[j][0]).bit_count() <= radius and fit(nodes[i][1], nodes[j][1])]
    want = least(names, linked)
    edges = simhash.stage(simhash.links(spark.createDataFrame([(n,) for n in names], "node binary"), radius=radius, n_words=n_words, sizes=sizes))
    got = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(edges).collect()}
    assert {n: got.get(n, n) for n in names} == want and len(set(want.values())) < len(names) - 50


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("s00", f"s{i:02d}") for i in range(1, 60)] + [("x", "x")]
    got = dict(rows(simhash.components(simhash.stage(spark.createDataFrame(pairs, "u string, v string")))))
    assert set(got.values()) == {"c000", "s00"} and len(got) == 101


@pytest.mark.parametrize("most", [3, 17, 200_000])
def test_components_however_many_edges_a_task_joins(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "FOREST_ROWS", most)
    draw = random.Random(most)
    pairs = [(draw.randrange(160), draw.randrange(160)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (300, 300)]
    named = [(f"{u:04d}", f"{v:04d}") for u, v in pairs]
    linked = {x: {b for a, b in named if a == x} | {a for a, b in named if b == x} for x in {x for p in named for x in p}}
    want = {}
    for x in sorted(linked):
        if x not in want:
            todo, own = [x], {x}
            while todo:
                todo += (new := linked[todo.pop()] - own)
                own |= new
            want |= {y: x for y in own if len(own) > 1}
    assert dict(rows(simhash.components(simhash.stage(spark.createDataFrame(named, "u string, v string"))))) == want


def test_simhash_of_odd_rows(spark, odd, none):
    got = simhash.digest(odd)
    assert got.count() == len(ODD) and rows(simhash.digest(none)) == []
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got.collect()}
    assert by[2, "0" * 16] == by[3, "0" * 16] == by[5, "0" * 16] == 2
    assert {c for (i, _), c in by.items() if i is None} == {None}


def test_keeping_one_of_each_group(spark, odd):
    draw = random.Random(9)
    base = [prose(draw, 200) + f" {draw.random()}" * 40 for _ in range(4)]
    docs = [(i, b, "a") for i, b in enumerate(base)] + [(10 + i, b + " one more word", "b") for i, b in enumerate(base)] + [(20, base[0], "c")]
    docs += [(30 + i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(120)), "d") for i in range(40)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, *range(30, 70)]
    odd_kept = simhash.keep_one(odd)
    assert odd_kept.columns == odd.columns
    # one row of the repeated ones; of null, empty and blank texts the first; a null id only where nothing else is
    assert sorted(str(r["doc_id"]) for r in odd_kept.collect()) == sorted(["1", "1", "2", "4", "6", "None"])
    assert simhash.keep_one(odd.limit(0)).count() == 0


@pytest.mark.parametrize("members", [128, 3])
def test_only_verified_links_drop_documents(spark, monkeypatch, members):
    """Against exact similarities, in one block and in many: shared passages alone, or repeated text, drop nothing."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    draw = random.Random(10)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, docs = fresh(300), []
    for n in (12, 30, 45, 60, 90, 110) * 2:  # similarities of some 0.55 to 0.95 between them
        docs.append(" ".join(passage + fresh(n)))
    docs += [" ".join(passage + fresh(5)) for _ in range(12)]
    twice = fresh(100)
    docs += [" ".join(twice), " ".join(twice + twice), " ".join(["again"] * 900 + fresh(30)), " ".join(["again"] * 900 + fresh(30))]
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {i: cut(t) for i, t in enumerate(docs)}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    roots = least(list(sets), [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])])
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    assert 8 <= len(set(roots.values())) <= len(docs) - 8


def test_arrow_batches_only_shrink(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    python_workers(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sample_by_hash(spark):
    rows_ = spark.range(20_000).withColumnRenamed("id", "k").repartition(7)
    few = sorted(r["k"] for r in hash_sample(rows_, "k", 300).collect())
    assert len(few) == 300 and few == sorted(r["k"] for r in rows_.orderBy(F.shiftrightunsigned(F.xxhash64("k"), 11)).limit(300).collect())
    assert hash_sample(rows_.limit(5), "k", 300).count() == 5 and hash_sample(rows_.limit(0), "k", 300).count() == 0


# All of them

CLASHES = (
    "block", "part", "rest", "stream", "words", "unit", "space", "node", "text_hash", "root", "first", "n", "digests", "sizes", "fresh", "place", "total", "_page", "_sha1", "refers_to", "revisit",
    "_words", "_place", "_word", "window", "windows", "items", "run", "_text", "row", "list", "codes", "own", "query", "score", "label", "at", "_key", "_n", "_all", "_source", "salt", "host", "path", "rows", "copies",
)


@pytest.mark.parametrize("name", ["quality", "lm", "simhash", "tokenstore", "mixing", "decontam", "urls", "warc", "ann"])
def test_queries_with_columns_of_any_name(spark, odd, pages, name):
    from loomgraph.llm import decontam, mixing, urlrep

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three"), (2, "word word word")], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 7, -1.0]) for i in range(120)], "vec_id long, embedding array<double>")
    table, ask = {
        "quality": (odd, lambda d: quality.digest(d, labels)),
        "lm": (odd, lm.digest),
        "simhash": (odd, simhash.digest),
        "tokenstore": (odd, tokenstore.digest),
        "mixing": (odd, mixing.digest),
        "decontam": (odd, lambda d: decontam.digest(d, items)),
        "urls": (pages, lambda d: urlrep.judge(d, labels)),
        "warc": (pages, warc.digest),
        "ann": (vectors, ann.digest),
    }[name]
    taken = {c.lower() for c in table.columns}
    clashing = table.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in taken})
    assert rows(ask(clashing)) == rows(ask(table))
