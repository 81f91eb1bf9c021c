"""Source divergence, centroid clustering and license scans: brute force, SQL, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.llm import catalogue, centroids, divergence, licenses

from .test_native import DOCS, ODD

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_centroids", "op13_licenses"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(catalogue.ORACLES[name]).select(*columns)
    assert [tuple(r) for r in rows(got.select(*columns))] == sorted(want.fetchall(), key=str)


# Source divergence


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def audit_by_hand(docs, least, top):
    """docs: (text, lang, source)."""
    of, n = defaultdict(set), defaultdict(Counter)
    langs = defaultdict(set)
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        for t in terms(text):
            of[lang, t].add(i)
            n[lang, source][t] += 1
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for (x, t), d in of.items() if x == lang and len(d) >= least)
        v = len(kept)
        size = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (size[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(size.values()) + 5 * v) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -f, r) for r, (f, o) in enumerate(pairs, 1)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -f, r) for r, (f, t) in enumerate(more, 1)]
    return sorted(out, key=str)


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "über", "été", "x1y", "Zoë", "naïve", "the", "THE"]
    docs = []
    for _ in range(n):
        source = draw.choice(["a", "a", "a", "b", "c", "d", "é", "", None])
        words = [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 5, 40]))] + (["the"] * 50 if source == "a" else [])
        docs.append((draw.choice([" ", "-", "7"]).join(words) if draw.random() > 0.05 else None, draw.choice(["en", "en", "de", None]), source))
    return docs


@pytest.mark.parametrize(("size", "slice_rows", "block", "together"), [(1 << 20, 2048, 256, 3_000_000), (7, 2, 2, 10), (64, 3, 1, 100)])
def test_divergence_against_brute_force(spark, monkeypatch, size, slice_rows, block, together):
    """Whatever the pieces of a text, the slices of terms, the blocks of sources, and the rows that are scanned together."""
    monkeypatch.setattr(divergence.partial_runs, "__defaults__", (size, together))
    monkeypatch.setattr(divergence, "HELD", 2)
    docs = corpus(5)
    table = spark.createDataFrame([(i // 2, *d, 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n long").repartition(5)
    got = divergence.audit(table, min_documents=6, top=3, size=size, slice_rows=slice_rows, block=block)
    assert rows(got) == audit_by_hand(docs, 6, 3)


def test_a_run_that_batches_or_partitions_cut_is_one(spark):
    runs = [("en", "a", "x", i, 1, 2) for i in range(7)] + [("en", "b", "x", 9, 1, 1), ("en", "b", "y", 3, 2, 5)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(divergence.RUN.names, r)) for r in runs[a:b]], schema=divergence.RUN) for a, b in ((0, 3), (3, 3), (3, 8), (8, 9))]
    got = [tuple(r[c] for c in ("lang", "source", "term", "documents", "n")) for b in divergence.scan(iter(batches)) for r in b.to_pylist()]
    assert got == [("en", "a", "x", 7, 14), ("en", "b", "x", 1, 1), ("en", "b", "y", 2, 5)]


def test_a_term_longer_than_a_piece_is_whole():
    text = ("a" * 50 + " " + "é" * 20 + "-b").encode()
    assert b"".join(divergence.pieces(text, 8)).split() == ["a".encode() * 50, "é".encode() * 20, b"b"]


def test_divergence_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    want = audit_by_hand([(r[1], r[2], r[3]) for r in ODD], 30, 50)
    assert rows(divergence.digest(odd)) == want
    assert {r[4] for r in want} <= {0}  # no term is in 30 documents, so every pair is there with 0
    assert rows(divergence.digest(spark.createDataFrame([], DOCS))) == []
    twice = odd.unionByName(odd)
    assert rows(divergence.audit(twice, min_documents=2)) == audit_by_hand([(r[1], r[2], r[3]) for r in ODD] * 2, 2, 50)
    named = odd.withColumns({c: F.lit(1) for c in ("term", "n", "v", "block", "slice", "value", "rank", "documents", "held")})
    assert rows(divergence.digest(named)) == want


def test_chances_are_exact_beyond_63_bits(spark):
    big = 4 * 10**17
    got = spark.range(1).select(divergence.chance(F.lit(big), F.lit(3 * big + 1), F.lit(7)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 1 + 35)


# Centroid clustering


VECTORS = "vec_id long, embedding array<float>, label int"


def clusters_by_hand(vectors, k, rounds, dims):
    x = [(v, [math.floor(256 * c) for c in e]) for v, e in vectors if e is not None and len(e) == dims and all(c is not None and math.isfinite(c) for c in e)]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(r[1]) for r in order[:k]]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(e)[1] for _, e in x]
        for c in range(len(centers)):
            if members := [e for (_, e), o in zip(x, own) if o == c]:
                centers[c] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((v, *reversed(near(e))) for v, e in x), key=str), centers


def some_vectors(seed, n, dims, spread):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    out = [(i, [np.float32(m + draw.gauss(0, spread)).item() for m in draw.choice(middles)]) for i in range(n)]
    return [*out, (3, out[3][1]), (n, out[0][1]), (None, out[1][1])]  # repeated rows, copies, a null id


@pytest.mark.parametrize(("n", "dims", "spread", "k"), [(300, 6, 0.05, 9), (300, 6, 1.0, 9), (200, 2, 0.01, 12), (8, 3, 0.5, 40), (50, 4, 0.0, 7)])
def test_clusters_against_brute_force(spark, n, dims, spread, k):
    vectors = some_vectors(n, n, dims, spread)
    table = spark.createDataFrame([(v, e, 0) for v, e in vectors], VECTORS)
    got, centers = centroids.cluster(table, k=k, dims=dims)
    want, found = clusters_by_hand(vectors, k, 5, dims)
    assert centers.tolist() == found
    assert rows(got.select("vec_id", "cluster", "distance")) == want


def test_bounds_spare_scans_and_change_nothing():
    draw = np.random.default_rng(3)
    middles = draw.integers(-2000, 2000, (20, 8))
    x = (middles[draw.integers(0, 20, 5000)] + draw.integers(-60, 60, (5000, 8))).astype(np.int64)
    now = middles + 3
    cluster, upper, lower = centroids.scan(x, now)
    for step in range(4):
        moved = now + draw.integers(-20, 20, now.shape)
        drift = np.sqrt(((moved - now) ** 2).sum(axis=1).astype(float)) * (1 + centroids.WIDEN)
        cluster, upper, lower, scanned = centroids.reassign(x, cluster, upper, lower, moved, drift)
        far = ((x[:, None, :] - moved[None]) ** 2).sum(axis=2)
        assert (cluster == far.argmin(axis=1)).all()
        best = np.sort(np.sqrt(far), axis=1)
        assert (upper >= best[:, 0]).all() and (lower <= best[:, 1]).all()
        assert scanned < len(x) / 2, step
        now = moved


def test_ties_go_to_the_smaller_number():
    x, now = np.array([[0, 0], [1, 0]]), np.array([[2, 0], [-2, 0], [0, 2]])
    cluster, upper, lower = centroids.scan(x, now)
    assert cluster.tolist() == [0, 0]
    assert centroids.reassign(x, np.array([2, 0]), np.array([2.0, 1.0]), np.array([2.0, 2.0]), now, np.zeros(3))[0].tolist() == [0, 0]


def test_distances_of_large_numbers_are_exact():
    x, c = np.array([[2**26 + 1, -(2**26)]]), np.array([[-(2**26), 2**26 - 3]])
    assert centroids.distances(x, c).tolist() == [[(2**27 + 1) ** 2 + (2**27 - 3) ** 2]] == [centroids.own_distances(x, c, np.array([0])).tolist()]


def test_vectors_that_take_no_part(spark):
    good = [0.5] * 64
    bad = [None, [], good[:63], [*good, 1.0], [*good[:63], None], [*good[:63], float("nan")], [*good[:63], float("-inf")]]
    table = spark.createDataFrame([(1, good, 1), *((i, b, 0) for i, b in enumerate(bad, 2))], VECTORS)
    sha = hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest()
    assert rows(centroids.digest(table)) == [(1, 0, 0, 0, 0, sha)]
    assert rows(centroids.digest(table.where("vec_id > 1"))) == []
    assert rows(centroids.digest(table.withColumns({c: F.lit(1) for c in ("cluster", "vector", "upper", "was")}))) == [(1, 0, 0, 0, 0, sha)]


def test_components_that_do_not_fit_raise(spark):
    with pytest.raises(PySparkException, match="does not fit"):
        centroids.digest(spark.createDataFrame([(1, [1e30] * 64, 1)], VECTORS)).collect()


# License scans


def license_by_hand(text, templates, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = sorted((label, i) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    line = "".join(f" {w} " for w in words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 2)
    own = sorted({(label, i) for label, ts in templates.items() for t in ts for i in range(len(words)) if re.compile(licenses._pattern(t)).match(line, at[i])})
    return len(words), found, own


SMALL = {
    "x": ["a [[b]] {{1..2}} c", "{{0..2}} d a"],
    "y": ["[[a]] b [[c [[d]]]] a"],
    "z": ["c {{2..4}} [[a]] d"],
}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "é", "A", "7"]), max_size=40), st.sampled_from([3, 10, 1 << 20]))
def test_automata_accept_what_expressions_match(words, size):
    phrases = {"p": "a b", "q": "b b c"}
    scanner = licenses.Scanner(SMALL, phrases, size)
    n, found, spans = scanner.places(" ".join(words).encode())
    want = license_by_hand(" ".join(words), SMALL, phrases)
    assert (n, sorted(found), sorted({(label, start) for label, start, _ in spans})) == want


def test_wording_with_and_without_its_optional_parts():
    text = licenses.TEMPLATES["text:mit"][0]
    whole = re.sub(r"\{\{(\d+)\.\.\d+\}\}", lambda m: " ".join(["thing"] * int(m[1])), text.replace("[[", "").replace("]]", ""))
    short = re.sub(r"\[\[.*?\]\]", "", re.sub(r"\{\{\d+\.\.(\d+)\}\}", lambda m: " ".join(["thing"] * int(m[1])), text))
    scanner = licenses.Scanner()
    labels = lambda words: {x for x, _, _ in scanner.places(words.encode())[2]}
    assert labels(whole) == labels(short) == labels("so: " + short.upper() + ", and on") == {"text:mit"}
    assert labels(whole.replace("hereby", "now")) == set()
    assert labels("Released under the MIT License.") == {"notice:mit"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"notice:gpl-3.0"}
    assert labels("Licensed under the Apache License, Version 2.0. All rights reserved.") == {"notice:apache-2.0", "notice:all-rights-reserved"}
    assert labels("the license of the Apache") == set()


@pytest.mark.parametrize("text", ["a [[b", "a ]] b", "[[a]]", "{{1..3}}", "a {{3..1}}", "[[a]] {{0..2}}", "", "a [ b"])
def test_markup_that_says_nothing_raises(text):
    with pytest.raises(licenses.TemplateError):
        licenses.Automaton(text).anchors()


def test_license_of_odd_rows(spark):
    long = ("word " * 50_000 + "MIT\nLicense ") * 3 + "mit license" + "x" * 3_000_000
    docs = [*ODD, (90, long, "en", "s", 0), (91, "MIT license, Apache license; MIT-license general public licenses", "en", None, 0)]
    got = {r["doc_id"]: r for r in licenses.digest(spark.createDataFrame([d for d in docs if d[0] is not None], DOCS)).collect()}
    assert got[90]["n_words"] == 3 * 50_002 + 2 and got[90]["n_base"] == 3 and (got[90]["first_word"], got[90]["last_word"]) == (50_000, 2 * 50_002 + 50_000)
    r = got[91]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (3, 0, 4, "apache,mit", "apache,mit")
    assert r["score"] == 0.75
    empty = spark.createDataFrame([(1, None, None, None, None), (1, "", None, None, None), (None, " \n", None, None, None)], DOCS)
    assert rows(licenses.digest(empty)) == sorted([(1, 0, 0, None, None, "", "", 0.0)] * 2 + [(None, 0, 0, None, None, "", "", 0.0)], key=str)
    assert rows(licenses.digest(spark.createDataFrame([], DOCS))) == []
    same = licenses.digest(empty.withColumns({c: F.lit(1) for c in ("phrases", "matches", "labels", "score")}))
    assert len(same.collect()) == 3
