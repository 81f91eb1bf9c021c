"""Mixing, sharding, url judgement and decontamination: SQL on fixtures, edge cases, brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, sharding, urlrep

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and very long texts, repeated rows and ids.
ODD = [
    (1, "one two three", "en", "b", 13), (1, "one two three", "en", "b", 13), (1, "another text", "en", "a", 12), (2, None, None, None, None), (3, "", "en", None, 0),
    (None, "no id here", "en", "a", 10), (None, "no id here", "en", "a", 10), (4, "word " * 20_000, "de", "a", 100_000), (5, " \t\n ", "en", "c", 4), (6, "Ünï cödé \u3000 x", "fr", "b", 9),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_sql(sql, **tables):
    """The SQL's rows over pandas tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def same(df, sql, **tables):
    names, want = by_sql(sql, **tables)
    assert rows(df.select(*names)) == sorted(want, key=str)


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


# Mixing


def test_mixing_of_odd_rows(odd, none):
    same(mixing.digest(odd), mixing.ORACLE, documents=odd)
    assert rows(mixing.digest(none)) == []


def test_mixing_fills_to_the_cap_and_shares_the_excess(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate("a" * 10 + "b" * 100 + "c" * 100)], "doc_id long, text string, source string")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(docs).collect()}
    total = 1.5 * 2100
    assert targets["a"] == 200  # capped at twice its 100 words
    assert targets["b"] == pytest.approx((total - 200) / 3) and targets["c"] == pytest.approx((total - 200) * 2 / 3)
    assert sum(targets.values()) == pytest.approx(total) and all(targets[s] <= 2 * n for s, n in (("a", 100), ("b", 1000), ("c", 1000)))


def test_mixing_emits_what_it_plans(spark, odd):
    planned = mixing.plan(odd.withColumn("size", F.lit("clash")))
    emitted = mixing.emit(planned, odd.columns)
    assert emitted.columns == odd.columns and emitted.count() == planned.agg(F.sum("copies")).first()[0]
    assert rows(mixing.plan(odd)) == rows(mixing.plan(odd))  # reruns agree
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), f"s{i % 7}") for i in range(7000)], "doc_id long, text string, source string")
    taken = mixing.plan(docs).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(taken) == 7 and all(r["taken"] == pytest.approx(r["target"], rel=0.06) for r in taken)


@pytest.mark.parametrize("ids", ["null", "one", "copies", "own"])
def test_sources_come_near_their_targets_whatever_the_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = [({"null": None, "one": 7, "copies": 7, "own": i}[ids], "same five words in all" if ids == "copies" else f"{i} " + "w " * 2, s, i % 3) for s in "abc" for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, other int")
    planned = mixing.plan(frame)
    assert planned.count() == 3000 and planned.where(F.col("size") * F.col("copies") > 2 * F.col("size")).isEmpty()
    taken = planned.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(taken) == 3 and all(r["taken"] == pytest.approx(r["target"], rel=0.03) for r in taken)
    assert rows(planned) == rows(mixing.plan(frame.repartition(7, "text")))  # whatever the partitions
    assert rows(mixing.mix(frame).groupBy(*frame.columns).count()) == rows(mixing.mix(frame.repartition(3)).groupBy(*frame.columns).count())
    same(mixing.digest(frame), mixing.ORACLE, documents=frame)


def test_mixing_with_many_sources_joins_by_salt(spark, odd, monkeypatch):
    want = rows(mixing.digest(odd))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows(mixing.digest(odd)) == want


# Sharding


def test_shards_hold_every_row_once(spark, odd):
    docs = odd.unionAll(spark.createDataFrame([(i, f"text {i} " * 50, "en", "s", 1) for i in range(500)], DOCS)).repartition(6)
    out = sharding.shard(docs, target=60_000, smallest=2_000)
    assert rows(out.drop("shard", "shard_tier", "shard_version")) == rows(docs)
    assert rows(sharding.shard(docs.limit(0)).drop("shard", "shard_tier", "shard_version")) == []


def test_versions_are_snapshots_and_merges_approach_the_target(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=40_000, smallest=1_000, fanout=3)
    docs = spark.createDataFrame([(i, "".join(random.Random(i).choices("abcdefgh ", k=300))) for i in range(900)], "doc_id long, text string").repartition(3)
    for part in range(3):
        store.append(docs.where(F.col("doc_id") % 3 == part))
    before = store.manifest()
    assert before["version"] == 3 and sum(s["rows"] for s in before["shards"]) == 900
    after = store.compact()
    assert len(after["shards"]) < len(before["shards"]) and sum(s["rows"] for s in after["shards"]) == 900 and store.due(after) == []
    assert rows(store.read().select("doc_id")) == rows(docs.select("doc_id")) == rows(store.read(3).select("doc_id"))
    assert store.read(1).count() == 300
    assert store.vacuum() == len(before["shards"]) and store.read().count() == 900


def test_a_version_is_committed_once(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    base = store.manifest()
    store.commit(base, [], "{}")
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], "{}")
    assert store.versions() == [1]


def test_files_without_a_commit_are_never_read(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(10))
    spark.range(99).write.parquet(f"{store.root}/data/a000000002-lost")  # a writer that died
    assert store.read().count() == 10 and store.vacuum() > 0


@pytest.mark.parametrize("values", [["1 10:00", "1 q", "1%", "%3A", "a+b", "x/y", "Ünï {a} [b]*?"], [None, "", "n"], [1.5, float("inf")]])
def test_arrivals_of_any_value_are_read_back(spark, tmp_path, values):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=60_000, smallest=100, fanout=3)
    docs = spark.createDataFrame([(i, values[i % len(values)], f"text {i}") for i in range(70)], f"doc_id long, at {'double' if isinstance(values[0], float) else 'string'}, text string")
    store.append(docs.coalesce(1), F.col("at"))
    assert sum(s["rows"] for s in store.manifest()["shards"]) == 70
    got = store.read()
    assert rows(got.select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
    assert {r["shard"] for r in got.select("shard").collect()} == {s["path"] for s in store.manifest()["shards"]}
    store.compact()
    assert rows(store.read().select("doc_id", "text")) == rows(docs.select("doc_id", "text"))


def test_columns_may_come_and_go_but_not_change_their_type(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=3)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", [7])], "doc_id long, Text string, more array<int>"))
    store.append(spark.createDataFrame([(3,)], "doc_id long"))
    want = [(1, "a", None), (2, "b", [7]), (3, None, None)]
    for refused in ("doc_id string", "doc_id long, more array<string>"):
        with pytest.raises(sharding.SchemaMismatch):
            store.append(spark.createDataFrame([], refused))
    assert rows(store.read().select("doc_id", "text", "more")) == rows(spark.createDataFrame(want, "doc_id long, text string, more array<int>"))
    assert store.compact()["version"] == 4 and store.vacuum() > 0
    assert rows(store.read().select("doc_id", "text", "more")) == rows(spark.createDataFrame(want, "doc_id long, text string, more array<int>"))
    assert store.versions() == [1, 2, 3, 4]


def test_columns_called_like_the_stores_own_are_kept(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1, "mine", 9)], "doc_id long, shard string, shard_tier int"))
    row = store.read().first()
    assert (row["shard"], row["shard_tier"], row["shard_tier_"], row["shard_version"]) == ("mine", 9, 0, 1) and row["shard_"].startswith("data/a")


def test_a_name_that_is_taken_by_a_folder_raises(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    base = store.manifest()
    (tmp_path / "s" / "manifests").mkdir(parents=True)
    (tmp_path / "s" / "manifests" / "v000000001.json").mkdir()  # no file, so it can't be replaced
    with pytest.raises(Exception):
        store.commit(base, [], None)


def test_only_a_taken_version_is_a_conflict(spark, tmp_path):
    (tmp_path / "s").write_text("a file where the store's folder should be")
    with pytest.raises(Exception) as raised:
        store = sharding.ShardStore(spark, str(tmp_path / "s"))
        store.commit({"version": 0}, [], None)
    assert not isinstance(raised.value, sharding.Conflict)


def test_each_rows_shard_tier_and_version_by_the_files(spark, tmp_path):
    """The files that a store has left, read one by one without Spark, against what the digest says of each row."""
    import os

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, "".join(random.Random(i).choices("abcdefgh ", k=200 + 40 * (i % 9)))) for i in range(800)] + [(None, None), (5, "")], "doc_id long, text string").repartition(5)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=80_000, smallest=4_000, fanout=3)
    for part in range(4):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == part), F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    store.compact()
    manifest = store.manifest()
    want = []
    for s in manifest["shards"]:
        full = tmp_path / "s" / s["path"]
        size, tier = os.path.getsize(full), 0
        while size >= 4_000 * 3**tier:
            tier += 1
        assert (s["bytes"], s["tier"]) == (size, tier) and size <= 1.5 * 80_000
        table = pq.ParquetFile(full).read(["doc_id", "text"]).to_pylist()
        assert len(table) == s["rows"]
        want += [(r["doc_id"], r["text"], s["path"], tier, int(s["path"].split("/")[1][1:10])) for r in table]
    assert rows(store.read().select("doc_id", "text", "shard", "shard_tier", "shard_version")) == sorted(want, key=str)
    assert sorted((r[:2] for r in want), key=str) == rows(docs.select("doc_id", "text"))
    by_tier = {}
    for s in manifest["shards"]:
        if 2 * s["bytes"] <= 80_000:
            by_tier.setdefault(s["tier"], []).append(s)
    assert all(len(run) < 3 for run in by_tier.values())


# Urls

PAGES = "page_id long, url string, html string"
URLS = [
    (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://example.net/de/", ""), (3, "http://sub.example.com/de/", ""), (4, "http://example.com/fr/", ""), (5, "http://x.org/fr/1", ""),
    (6, "http://x.org?y=/fr/", ""), (7, None, None), (8, "no scheme/here", ""), (9, "", ""), (None, "http://other.co.uk:80/p", ""), (10, "http://notexample.net", ""), (10, "http://notexample.net", ""),
    (11, "x://h://net/", ""), (12, "http://net/a", ""), (13, "http://good.example.org/" + "p" * 100_000, ""),
]


def test_urls_against_sql(spark):
    pages = spark.createDataFrame(URLS, PAGES)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 1), (4, 0, 0), (5, 1, 0), (10, None, 0), (None, 1, 0), (13, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    judged = urlrep.judge(pages, labels)
    same(judged, urlrep.ORACLE, pages=pages, labels=labels)
    assert judged.count() == len(URLS)
    got = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("x.org", "", None) and got[7][:3] == ("", "", None) == got[8][:3]
    assert got[10][:3] == ("notexample.net", "", None)  # the rule asks for a path
    assert got[11][:2] == ("h:", "//net/") and got[12][2:] == ("net/", "block")


def test_urls_without_labels_or_rows(spark):
    pages, none = spark.createDataFrame(URLS, PAGES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(urlrep.judge(pages, none), urlrep.ORACLE, pages=pages, labels=none)
    assert rows(urlrep.judge(pages.limit(0), none)) == []


@pytest.mark.parametrize(
    "host, suffix, domain",
    [
        ("a.b.example.com", "com", "example.com"), ("x.co.uk", "co.uk", "x.co.uk"), ("s.co.nz", "co.nz", "s.co.nz"), ("co.nz", "co.nz", "co.nz"), ("a.github.io", "github.io", "a.github.io"), ("b.a.github.io:8080", "github.io", "a.github.io"),
        ("10.1.2.3", "10.1.2.3", "10.1.2.3"), ("99.9.2.3:80", "99.9.2.3", "99.9.2.3"), ("[2001:db8::1]:80", "[2001:db8::1]", "[2001:db8::1]"), ("example.com.", "com", "example.com"), ("example.com.:80", "com", "example.com"),
        ("bucket.s3.amazonaws.com", "s3.amazonaws.com", "bucket.s3.amazonaws.com"), ("localhost", "localhost", "localhost"), ("", "", ""), ("1.2.3", "3", "2.3"),
    ],
)
def test_registered_domains(spark, host, suffix, domain):
    got = spark.createDataFrame([(host,)], "host string").select(*urlrep.suffix_and_domain(F.col("host"))).first()
    assert tuple(got) == (suffix, domain)


def test_suffixes_are_a_parameter_and_odd_hosts_agree_with_sql(spark):
    got = spark.createDataFrame([("x.y.toy",)], "host string").select(*urlrep.suffix_and_domain(F.col("host"), ("y.toy",))).first()
    assert tuple(got) == ("y.toy", "x.y.toy")
    hosts = ["a.github.io", "b.github.io", "10.1.2.3", "99.9.2.3:80", "[::1]:80", "example.com.", "example.com", "s.co.nz", "t.co.nz", "bucket.s3.amazonaws.com"]
    pages = spark.createDataFrame([(i, f"http://{hosts[i % len(hosts)]}/p{i}", "") for i in range(80)], PAGES)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    same(urlrep.judge(pages, labels), urlrep.ORACLE, pages=pages, labels=labels)


def test_reputation_shrinks_to_the_domain(spark):
    outcomes = [("a.good.com", 50, 48), ("b.good.com", 1, 0), ("a.bad.com", 50, 1), ("b.bad.com", 1, 1), ("new.bad.com", 0, 0)]
    known = {r["host"]: r for r in urlrep.reputations(spark.createDataFrame(outcomes, "host string, n long, good long")).collect()}
    assert known["b.good.com"]["good_rate"] > known["b.bad.com"]["good_rate"] > known["new.bad.com"]["good_rate"]
    assert all(r["good_bound"] < r["good_rate"] for r in known.values())


# Decontamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    found = {}
    for item, text in items:
        w = words(text)
        if w:
            found.setdefault(item, []).extend(tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, windows in found.items():
            for run in set(windows):
                for i in range(len(w) - len(run) + 1):
                    if tuple(w[i : i + len(run)]) == run:
                        hit |= set(range(i, i + len(run)))
                        names |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontam.BLOCK, 3])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    draw = random.Random(5)
    vocabulary = ["the", "of", "a", "Ünï", "É", "É".lower(), "x1", "long", "rare", "words", "here", "and", "there", "b2b"]
    say = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ",", "."]) for _ in range(n))
    items = [(k, say(draw.choice([1, 3, 12, 13, 14, 30]))) for k in range(12)] + [(3, say(20)), (50, ""), (51, None), (None, say(20)), (None, "x1 x1 x1"), (52, "... !!")]
    docs = [(i, say(draw.randrange(60))) for i in range(60)]
    docs += [(100 + k, say(20) + " " + (text or "").upper() + "-" + say(30)) for k, (_, text) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "..."), (1, docs[1][1]), (1, "other text"), (None, items[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"window": F.lit("clash"), "items": F.lit(1)})
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(frame, benchmark).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert rows(got) == brute(docs, items)
    same(decontam.digest(frame, benchmark), decontam.ORACLE, documents=frame.select("doc_id", "text"), benchmark=benchmark)
    kept = decontam.clean(frame, benchmark)
    assert kept.columns == frame.columns and kept.count() == sum(not r[4] for r in brute(docs, items))


def test_a_window_of_most_documents_meets_its_items_where_it_is(spark, monkeypatch):
    """Hot windows with many items and with one, in blocks of two items, and windows that aren't hot."""
    monkeypatch.setattr(decontam, "FEW", 0)
    monkeypatch.setattr(decontam, "HOT", 4)
    monkeypatch.setattr(decontam, "BLOCK", 2)
    items = [(k, "of all the passages here one is everywhere") for k in range(7)] + [(10, "some words of a few"), (11, "only once"), (None, "of all the passages here one is everywhere")]
    docs = [(i, "so of all the passages here one is everywhere" + (" some words of a few" if i % 9 == 0 else "") + (" only once" if i == 20 else "")) for i in range(40)] + [(50, "clean"), (51, None)]
    got = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got.select("doc_id", "n_words", "n_hit", "items", "contaminated")) == brute(docs, items)


def test_decontamination_of_empty_tables(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert rows(decontam.digest(none, benchmark)) == []
    clean = decontam.scan(odd, benchmark.limit(0))
    assert clean.count() == len(ODD) and clean.where("contaminated").isEmpty()
    assert decontam.scan(odd, benchmark).where("contaminated").select("doc_id").distinct().collect() == [(1,)]
