"""Near duplicates, components, web archives, URL filter and the pipeline."""

import gzip
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, fingerprint, graph, langid, near_duplicates, packing, pii, quality, queries, simhash, urlfilter, warc
from quillon.llm.graph import components
from tests.llm.test_text_operators import prose


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.find(i)] = self.find(j)


# ---- components


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(1, 1)], [], [(5, 2), (2, 5), (9, 7), (7, 5), (100, 101)]])
def test_components(spark, edges):
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    s = Sets({v for e in edges for v in e})
    for a, b in edges:
        s.join(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert set(got) == linked
    assert all((got[a] == got[b]) == (s.find(a) == s.find(b)) for a in linked for b in linked)


# ---- 10: SimHash


def test_masks_cover():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 3, 4):
        family = simhash.masks(radius)
        assert len(family) == 2 ** (radius + 1) - 1
        for _ in range(300):
            differ = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(not m & differ for m in family)


def test_fingerprint_by_definition():
    import xxhash

    for text in ("A b\tC d e\x0bf É", "one two", "", "  ", "a a a a a a a", "x y"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.majority(simhash.word_shingles(text, 4)) == want


@pytest.mark.parametrize("most", [4096, 3])
def test_near_groups(spark, monkeypatch, most):
    """Equal to brute force, also where every bucket is dealt a second time."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(2)
    fps = [0, 0, 15, 31]
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
    rows = [(1000 - i if i else None, simhash._signed(f)) for i, f in enumerate(fps)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    s = Sets(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                s.join(i, j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[s.find(i)] = min(low.get(s.find(i), 1 << 60), k)
    want = sorted((k or -1, f, low[s.find(i)]) for i, (k, f) in enumerate(rows))
    assert sorted((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in got) == want


def test_simhash_query_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "A b c d e"), (9, "a B c d e")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    out = simhash.near_groups(simhash.fingerprints(docs)).select("doc_id", simhash.as_hex("fp").alias("f"), "component_id").collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out) == [(0, 9), (1, 1), (2, 1), (3, 1), (3, 1), (9, 9)]
    assert {r["f"] for r in out if r["doc_id"] in (1, 2, 3)} == {"0" * 16} and all(len(r["f"]) == 16 for r in out)
    assert simhash.near_groups(simhash.fingerprints(docs.limit(0))).count() == 0


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            new = list(words)
            for _ in range(rng.randint(1, 3)):
                new[rng.randrange(len(new))] = "edit" + str(rng.randint(0, 99))
            texts.append(" ".join(new))
    texts += [texts[0], texts[0].upper() + "\n", "short text", "short text here", "", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)]
    docs = spark.createDataFrame([*rows, (None, "no id"), (None, "no id"), rows[4]], "doc_id long, text string").withColumn("v", F.lit(0))
    s = Sets(range(len(rows)))
    sets = [shingle_set(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if both == 0 or len(sets[i] & sets[j]) >= 0.8 * both:
                s.join(i, j)
    first = {}
    for i in range(len(rows)):
        first.setdefault(s.find(i), i)
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates.groups(docs).collect()}
    assert got == {i: first[s.find(i)] for i in range(len(rows))}
    left = near_duplicates.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted([(False, i) for i in first.values()] + [(True, 0)] * 2)
    assert near_duplicates.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("wider", [8, 2])
def test_near_duplicates_by_other_edits(spark, monkeypatch, wider):
    """Equal to brute force where texts are added, cut off or moved, down to the threshold."""
    monkeypatch.setattr(near_duplicates, "WIDER", wider)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    common = [word() for _ in range(30)]
    texts = []
    for n in [60, 100, 200, 400, 800, 1500] * 3:
        words = [word() for _ in range(n)] + (common if rng.random() < 0.5 else [])
        n = len(words)
        for share in (0.03, 0.1, 0.15, 0.19, 0.22, 0.24):
            k, i = round(share * n), rng.randrange(n)
            more = [word() for _ in range(k)]
            texts.append(words[i:] + words[:i] if k % 2 else words)
            texts += [words + more, more + words, words[: n - k], words[k:], words[:i] + more + words[i:]]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    s = Sets(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                s.join(i, j)
    first = {}
    for i in range(len(texts)):
        first.setdefault(s.find(i), i)
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: first[s.find(i)] for i in range(len(texts))}


def test_prefixes_meet():
    """Pairs at the threshold share a shingle of their prefixes, with no order of rarity in favour."""
    rng = np.random.default_rng(9)
    for n in [*range(1, 40), 500]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        counts = rng.integers(0, 3, 64)
        for cut in range(n // 5 + 1):
            b = np.sort(rng.permutation(a)[cut:])
            if len(b) and len(b) >= 0.8 * n:
                assert set(near_duplicates.prefix(a, counts, 0.8).tolist()) & set(near_duplicates.prefix(b, counts, 0.8).tolist())


def test_similar():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40, 300):
        for _ in range(50):
            a, b = (np.unique(rng.integers(0, max(2, n + n // 4), n, dtype=np.uint64)) for _ in range(2))
            both = len(np.intersect1d(a, b))
            assert near_duplicates.similar(a, b, 0.8) == (both >= 0.8 * (len(a) + len(b) - both) - 1e-9)
            differ = sum(int(np.bitwise_count(x)) for x in near_duplicates.parities(a).view(np.uint64) ^ near_duplicates.parities(b).view(np.uint64))
            assert differ <= len(a) + len(b) - 2 * both
    none = np.zeros(0, dtype=np.uint64)
    assert near_duplicates.similar(none, none, 0.8) and not near_duplicates.similar(none, np.ones(1, dtype=np.uint64), 0.8)


def test_chain_of_near_copies(spark, monkeypatch):
    """A chain, whose ends are not similar, is one group; shares of a pivot's texts are dealt apart."""
    monkeypatch.setattr(near_duplicates, "SHARE", 4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if j not in range(2 * i) else f"x{j}" for j, w in enumerate(words)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["group_id"] for r in near_duplicates.groups(docs).collect()} == {0}


def test_large_group_is_compared_in_proportion(spark, monkeypatch):
    """A text and m copies with an edit each: comparisons grow with m, not with its square."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    seen = {}
    real = near_duplicates.verified

    def counted(pairs, *rest):
        seen[m] = seen.get(m, 0) + pairs.count()
        return real(pairs, *rest)

    monkeypatch.setattr(near_duplicates, "verified", counted)
    for m in (64, 512):
        texts = [" ".join(words)]
        for i in range(m):
            new = list(words)
            for _ in range(3):
                new[rng.randrange(150)] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(new))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r["group_id"] for r in near_duplicates.groups(docs).collect()} == {0}
        assert seen[m] <= 8 * m
    assert seen[512] <= 1.5 * 8 * seen[64]


def test_ids_that_repeat(spark):
    """Rows that share an id are judged by their own texts; nothing distinct is lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, c), (3, a), (2, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit("clash"))
    got = near_duplicates.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, a), (1, b), (2, c)])


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(words[:-5000]), " ".join(words[30_000:]), "x" * 300_000]
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


# ---- 5: web archives


def test_read_warc(spark, tmp_path):
    one = warc.warc_record("response", "http://a.org/x", "2024-01-01T00:00:00Z", "urn:1", {"ETag": '"v1"', "Content-Type": "text/html"}, b"<p>\r\n\r\nbody" * 9, digest="sha1:A")
    two = warc.warc_record("revisit", "http://a.org/x", "2024-01-02T00:00:00.5Z", "urn:2", {"ETag": '"v1"', "Date": "later"}, status="304 Not Modified")
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, one, two))))
    (tmp_path / "b.warc").write_bytes(info + one + two)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, [str(tmp_path / n) for n in ("a.warc.gz", "b.warc", "c.warc")]).collect()
    assert len(rows) == 4 and [r["status"] for r in rows] == [200, 304] * 2
    assert rows[0]["headers"] == {"etag": '"v1"', "content-type": "text/html"} and bytes(rows[0]["body"]) == b"<p>\r\n\r\nbody" * 9
    assert rows[1]["ts"] - rows[0]["ts"] == 86_400_500_000 and rows[0]["digest"] == "sha1:A"


@pytest.mark.parametrize("url, key", [("HTTP://WWW.A.org:80/x/?b=2&a=1&utm_source=q#f", "a.org/x?a=1&b=2"), ("https://a.org", "a.org"), ("https://a.org/?ref=1", "a.org"), ("a.org/P/", "a.org/P")])
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


def test_revisits_against_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        head = {k: v for k, v in (("ETag", f'"{rng.randint(0, 2)}"'), ("Last-Modified", f"d{rng.randint(0, 1)}"), ("Date", f"t{i}"), ("Content-Type", f"c{i}")) if rng.random() < 0.7}
        rows.append((f"r{i:03d}", rng.choice(["http://hot.org/"] * 6 + ["http://b.org/", "http://c.org/#x", None]), rng.choice([*range(60), None]), rng.choice(["response", "revisit"]), head, rng.choice([None, "s1", "s2"])))
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, headers map<string,string>, digest string").withColumn("outcome", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for rid, url, ts, kind, head, digest in rows:
        if kind != "revisit":
            continue
        key = url and url.removeprefix("http://").split("/")[0]
        before = [r for r in rows if r[3] == "response" and url and r[1] == url and ts is not None and r[2] is not None and r[2] < ts]
        own = {k.lower(): v for k, v in head.items()}
        if not before:
            assert (got[rid]["outcome"], got[rid]["resolved_id"]) == ("missing", None) and dict(got[rid]["headers"]) == own
            continue
        hit = max(before, key=lambda r: (r[2], r[0]))
        its = {k.lower(): v for k, v in hit[4].items()}
        same = next((a == b for a, b in ((own.get("etag"), its.get("etag")), (own.get("last-modified"), its.get("last-modified")), (digest, hit[5])) if a is not None and b is not None), None)
        want = "unverified" if same is None else "resolved" if same else "mismatch"
        assert (got[rid]["outcome"], got[rid]["resolved_id"], got[rid]["canonical_url"]) == (want, hit[0], key)
        merged = its | {k: v for k, v in own.items() if k in warc.PERMITTED} if same else own
        assert dict(got[rid]["headers"]) == merged
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# ---- 9: URL filter


def loop_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_rules_and_trees(spark):
    urls = ["http://X.Example.ORG/es/1?a=1#b", "https://example.org/en/12", "https://notexample.org/es/", "http://a.com/fr/x", "http://a.com/de/y", "http://com/fr/", "http://org", "http://org/", "http://a.net/q?x#y", "no scheme", None, "", "x://y://z/a", "http://ÀB.org/?", "http://a.org?x://b.com/de/"]
    rng = random.Random(5)
    urls += [f"http://h{rng.randint(0, 9)}.com/{rng.choice(['fr', 'de'])}/{'9' * rng.randint(1, 3)}" for _ in range(200)] + [f"http://spam-{i}.net/{'7' * 30}" for i in range(10)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, queries.RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule = loop_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.text), u
        assert got[i]["verdict"] == (rule.verdict if rule else "block" if got[i]["score"] > 0.5 else "allow")
    assert got[8]["rule"] is None and 0 <= got[8]["score"] <= 1
    none = urlfilter.judge(pages.filter("page_id in (8, 9, 10)"), queries.RULES).collect()
    assert [r["verdict"] for r in none] == ["allow"] * 3
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0
    assert urlfilter.judge(pages.union(pages), queries.RULES).count() == 2 * len(urls)


def test_trees_learn(spark):
    rng = random.Random(6)
    rows = [(f"http://a.net/{'x' * n}", "a.net", "/" + "x" * n, int(n > 20)) for n in (rng.randint(1, 40) for _ in range(400))]
    trees = urlfilter.train(spark.createDataFrame(rows, "url string, host string, path string, blocked int"))
    df = spark.createDataFrame([(u, h, p) for u, h, p, _ in rows], "url string, host string, path string")
    margin = [r["m"] for r in trees.binned(trees.with_suffix(urlfilter.lexical(df))).select(F.expr(trees.score).alias("m")).collect()]
    assert sum((m > 0) == bool(b) for m, (*_, b) in zip(margin, rows, strict=True)) >= 390


def test_every_suffix_has_its_rate(spark):
    rows = [(f"http://a{i}.s{i % 400}/", f"a{i}.s{i % 400}", "/", int(i % 400 < 200)) for i in range(1200)]
    trees = urlfilter.train(spark.createDataFrame(rows, "url string, host string, path string, blocked int"))
    df = spark.createDataFrame([("http://b.s7/", "b.s7", "/"), ("http://b.s399/", "b.s399", "/"), ("http://b.new/", "b.new", "/"), (None, "", "")], "url string, host string, path string")
    got = [r["suffix_rate"] for r in trees.with_suffix(urlfilter.lexical(df)).orderBy("host").collect()]
    assert trees.suffixes.count() == 400 and got == pytest.approx([0.5, 0.5, 10 / 23, 13 / 23])


def test_url_query_against_loop(spark):
    """The registered query's rules and verdicts on its whole table."""
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.QUERIES["op9_url_filter"](spark, str(data)).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        host, path, rule = loop_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["score"] > 0.5 else "allow")


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"] and cp.ORACLE_SQL is None
    rng = random.Random(7)
    docs = [(i, prose(rng, 80)) for i in range(60)]
    docs += [(100 + i, " ".join(w + "$$$" for w in prose(rng, 60).split())) for i in range(30)]
    bench = [(i, " ".join(f"{rng.choice('pqrs')}{rng.randint(0, 999)}" for _ in range(25))) for i in range(5)]
    docs += [(200 + i, prose(rng, 40) + " " + bench[i][1] + " " + prose(rng, 40)) for i in range(5)]
    docs += [(300, docs[0][1] + " and more"), (301, docs[1][1]), (302, docs[2][1] + " write to ann@mail.example.com")]
    extra = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 100 or k >= 200), 0) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        rows = stage(spark, rows, str(tmp_path))
        rows.write.parquet(str(tmp_path / f"out{i}"))
        rows = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = rows
        if i < 4:
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r["doc_id"] for r in df.collect()} for n, df in seen.items()}
    assert ids["quality"] == {k for k, _ in docs if not 100 <= k < 200}
    assert ids["near_duplicates"] == ids["quality"] - {300, 301, 302}
    assert ids["decontamination"] == ids["pii"] == ids["packing"] == set(range(60))
    assert {(r["doc_id"], r["piece"]) for r in cp.run(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["piece"]) for r in seen["packing"].collect()}


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert all(hasattr(m, "__doc__") and "Defined results" in m.__doc__ for m in (decontaminate, fingerprint, graph, langid, near_duplicates, packing, pii, quality, simhash, urlfilter, warc))


def test_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, str(data)), c.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda it: sorted(map(repr, map(tuple, it)))
        assert rows(got.select(*columns).collect()) == rows(want.project(",".join(f'"{x}"' for x in columns)).fetchall())


def test_pipeline_links_by_simhash_and_by_similarity(spark):
    """Groups are the components of both kinds of links, and each kind has pairs that the other lacks."""
    import corpus_pipeline as cp

    rng = random.Random(21)
    texts = []
    for n in [40, 80, 300, 900, 2000] * 3:
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]
        texts.append(" ".join(words))
        for step in (41, 29, 23, 19):  # a word of so many is another: few bits differ, few shingles are in common
            texts.append(" ".join(f"edit{rng.randint(0, 999)}" if i % step == 7 else w for i, w in enumerate(words)))
        texts.append(" ".join(words + [f"more{rng.randint(0, 999)}" for _ in range(n // 6)]))
    texts += ["", None, "one two three", "one two  THREE"]
    rng.shuffle(texts)
    sets = [shingle_set(t or "") for t in texts]
    bits = [simhash.majority(simhash.word_shingles(t or "", 4)) for t in texts]
    both, one, kinds = Sets(range(len(texts))), Sets(range(len(texts))), {"bits": 0, "sets": 0}
    for i in range(len(texts)):
        for j in range(i):
            near = (bits[i] ^ bits[j]).bit_count() <= 4
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            kinds["bits"] += near and not alike
            kinds["sets"] += alike and not near
            if near or alike:
                both.join(i, j)
            if alike:
                one.join(i, j)
    assert min(kinds.values()) > 0 and len({both.find(i) for i in range(len(texts))}) < len({one.find(i) for i in range(len(texts))})
    first = {}
    for i in range(len(texts)):
        first.setdefault(both.find(i), i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in cp.keep_one(spark, docs, "").collect()} == set(first.values())
