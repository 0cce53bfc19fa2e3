"""Operators over whole tables: near-duplicates, vectors, archives and the pipeline."""

import glob
import gzip
import os
import random
import re
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import ann, pii, queries, simhash, warc
from furrow.operators import components as components_of
from furrow.operators.components import connected_components

RNG = random.Random(11)


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    texts = [None, "", "A", "a b", "one Two THREE four five", " ".join(RNG.choices("abcdef", k=300)), "x\x1cy z w"]
    assert simhash.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_links_lose_no_pair(spark):
    """Fingerprints around centres, so that many lie at distances of one to five."""
    fps = set()
    for _ in range(25):
        centre = RNG.getrandbits(64)
        for _ in range(20):
            x = centre
            for b in RNG.sample(range(64), RNG.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in found.collect()}
    want = components(pairs, fps)
    groups = lambda m: {frozenset(n for n in m if m[n] == r) for r in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def grouped(links, nodes):
    return {n: r for n, r in components([(int(a), int(b)) for x, y in links for a, b in zip(x, y, strict=True)], nodes).items()}


@pytest.mark.parametrize("kind", ["ball", "random", "both"])
def test_links_within_a_large_key(kind, monkeypatch):
    """Compared at once, searched and dealt on by parts, they join the same fingerprints."""
    rng = np.random.default_rng(2)
    held = np.uint64(0xABCD_EF00_0000_0000)
    some = rng.integers(0, 1 << 34, 600, dtype=np.uint64) if kind != "ball" else np.zeros(1, np.uint64)
    if kind != "random":
        flips = np.array([sum(1 << int(b) for b in rng.choice(34, rng.integers(0, 5), replace=False)) for _ in range(900)], np.uint64)
        some = np.concatenate((some, some[rng.integers(0, len(some), 900)] ^ flips))
    fps = np.unique(held | some)
    want = grouped(simhash.among(fps, 0), fps.tolist())
    for at_once, patience in ((512, 64), (16, 0.01), (64, 2), (1, 10**9)):
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        monkeypatch.setattr(simhash, "PATIENCE", patience)
        assert grouped(simhash.linked(fps, 0), fps.tolist()) == want


def test_a_key_of_a_hundred_thousand_fingerprints(spark):
    """They share a segment and more; the work stays near linear, within a task or dealt to several."""
    rng = np.random.default_rng(6)
    fps = np.unique(np.uint64(0x1234_5600_0000_0000) | rng.integers(0, 1 << 40, 100_000, dtype=np.uint64))
    planted = fps[:2000] ^ np.uint64(0b111)
    fps = np.unique(np.concatenate((fps, planted)))
    began = time.time()
    own = simhash.linked(fps[(fps >> np.uint64(34)) == fps[0] >> np.uint64(34)], 0)
    found = simhash.linked(fps, 0)
    assert time.time() - began < 60 and own is not None
    root = grouped(found, fps.tolist())
    assert all(root[int(a)] == root[int(a) ^ 0b111] for a in planted)
    few = spark.createDataFrame([(int(x),) for x in fps[:4000]], "fp long")
    split = {(r["u"], r["v"]) for r in simhash.links(few, key_prints=50).collect()}
    whole = {(r["u"], r["v"]) for r in simhash.links(few).collect()}
    nodes = {int(x) for x in fps[:4000]}
    assert components(split, nodes) == components(whole, nodes) and whole


def test_representatives(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words that stand here alone", "x"), (3, "and some more of quite another kind", "x"), (None, "a b c d", "x"), (None, "nobody has this text but me", "z"), (7, None, "x"), (6, "", "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, key_1 string").withColumn("fp", F.lit("x")).repartition(3)
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, "a b c d"), *[r[:2] for r in rows[3:5]], rows[6][:2], (6, "")])
    assert simhash.representatives(docs.where("false")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_near_duplicates(spark, monkeypatch, hot):
    """Also where a component of more than two fingerprints counts as hot."""
    if hot:
        monkeypatch.setattr(components_of, "HOT_SHARE", 2e-6)
        monkeypatch.setattr(simhash, "meet", lambda rows, few, on, n: components_of.meet(rows, few, on, 1_000_000))
    text = " ".join("".join(RNG.choices("abcdefgh", k=4)) for _ in range(400))
    near = [" ".join(("zz" if k == j else w) for k, w in enumerate(text.split())) for j in (5, 200, 399)]
    rows = [(9, text), (8, text), (7, near[0]), (12, near[1]), (11, near[2]), (3, None), (2, ""), (2, ""), (None, text), (None, "other words entirely here"), (1, "alone in the world of texts")]
    rows = [(*r, "x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = [brute_print(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    comp = components(pairs, range(len(rows)))
    want = sorted((repr(r[0]), f"{p:016x}", repr(min((rows[m][0] for m in comp if comp[m] == comp[k] and rows[m][0] is not None), default=None))) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
    got = sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def exact(vectors, k=5):
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids], float)
    n = np.sqrt((v * v).sum(1))
    out = {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            s = (v @ v[a]) / (n * n[a])
            order = [b for b in sorted(range(len(ids)), key=lambda b: (-round(s[b], 12), ids[b])) if b != a][:k]
            out[i] = [(ids[b], s[b]) for b in order]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    vectors = {int(k): rng.normal(size=16).astype(np.float32) for k in range(1500)}
    for k in range(40, 60):
        vectors[k] = vectors[0] * 2
    for k in (200, 201, 202):
        vectors[k] = vectors[300]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0, None] + [0.0] * 14), (5003, [float("nan")] * 16), (5004, [float("inf")] * 16), (5050, [1.0] * 3), (None, [1.0] * 16)]
    rows = [(k, [float(x) for x in v]) for k, v in vectors.items()] + odd
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, score int").repartition(3)
    got = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 50 == 0).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = exact(vectors)
    assert set(got) == set(want) and all([x[2] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({x[0] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hit >= 0.97 * 5 * len(want)
    assert [x[0] for x in got[0]][:5] == [40, 41, 42, 43, 44] and [x[0] for x in got[50]] == [0, 40, 41, 42, 43]
    for q in want:
        scores = dict(want[q])
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s, _ in got[q] if i in scores)
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2


def test_every_row_is_a_candidate(spark):
    """Repeated ids with other vectors, whole rows repeated, several lengths, clusters in 64 dimensions."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 64))
    rows = [(int(i), (centres[rng.integers(20)] + rng.normal(size=64) * rng.choice([0.01, 0.1, 0.5])).astype(np.float32).tolist()) for i in rng.integers(0, 700, 1500)]
    rows += rows[:200] + [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in rng.integers(0, 200, 60)] + [(50, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = Counter(), Counter()
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)] += 1
    for n in (64, 8, 2):
        ids, v = zip(*[(i, x) for i, x in rows if len(x) == n], strict=True)
        v = np.array(v, float)
        cos = v @ v.T / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))
        for a, i in enumerate(ids):
            if i % 50 == 0:
                order = [b for b in sorted(range(len(ids)), key=lambda b: (-round(cos[a, b], 12), ids[b])) if b != a][:5]  # noqa: B023
                want.update((i, k + 1, ids[b], round(cos[a, b], 9)) for k, b in enumerate(order))
    assert got == want


def test_nearest_among_thousands_of_near_copies(spark):
    """A third of the vectors closer together than codes can tell: none of the nearest is lost."""
    rng = np.random.default_rng(8)
    centre = ann.unit(rng.normal(size=(1, 64)))
    vectors = np.concatenate((ann.unit(rng.normal(size=(6000, 64))), centre + rng.normal(size=(3000, 64)) * rng.uniform(0.005, 0.02, (3000, 1))))[rng.permutation(9000)].astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(dict(enumerate(vectors.astype(float))))
    assert set(got) == set(want)
    assert sum(len(got[q] & {x[0] for x in want[q]}) for q in want) == 5 * len(want)


def test_anisotropic_codes_lose_less_along_the_vector():
    x = ann.unit(np.random.default_rng(4).normal(size=(3000, 64)))
    q = ann.Quantiser.train(x)
    plain = ann.Quantiser(q.centres, 1.0)
    along = lambda codes: np.abs((x * (x - np.concatenate([q.centres[s][codes[:, s]] for s in range(32)], 1))).sum(1)).mean()
    assert along(q.encode(x)) < along(plain.encode(x))


def test_loser_tree():
    for k in range(0, 9):
        runs = [sorted(RNG.randint(0, 30) for _ in range(RNG.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    ties = [[(1, "a"), (2, "a")], [(1, "b")], [(0, "c"), (2, "c")]]
    assert list(warc.LoserTree(ties, lambda x: x[0])) == [(0, "c"), (1, "a"), (1, "b"), (2, "a"), (2, "c")]


def test_archives(spark, tmp_path):
    big = "ä" * 600
    rows = [(1, "http://www.b.com/x y", big), (5, "https://a.com/?q=1", big), (3, None, big), (None, "http://[bad", big), (4, "http://a.com/", "short"), (6, "http://a.com/", "short"), (7, "http://c.org", None), (8, "http://c.org/z", "WARC/1.0\r\n\r\nnot a record\r\n\r\n"), (5, "https://a.com/?q=1", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.capture_index(spark, str(tmp_path / "w")).orderBy("seq").collect()
    assert len(got) == len(rows)
    order = [warc.capture_key(tuple(r)[2:]) for r in got]
    assert order == sorted(order)
    import hashlib

    for page, _, html in rows:
        raw = (html or "").encode()
        same = [r for r in got if r["page_id"] == page and r["payload_bytes"] == len(raw)]
        want = ("revisit", 5) if html == big and page != 5 else ("response", None)
        assert same and all((r["record_type"], r["refers_to"]) == want and r["payload_digest"] == hashlib.sha1(raw).hexdigest() for r in same)
    files = {os.path.basename(f): open(f, "rb").read() for f in glob.glob(str(tmp_path / "w" / "part*"))}
    assert all(gzip.decompress(f).startswith(b"WARC/1.0\r\nWARC-Type: ") and gzip.decompress(f).endswith(b"\r\n\r\n") for f in files.values())
    for r in got:
        head, _ = warc.read_record(files[r["run"]], r["offset"], r["length"])
        assert head.get("X-Page-Id") == (None if r["page_id"] is None else str(r["page_id"])) and head["WARC-Type"] == r["record_type"]
    assert warc.url_key("http://WWW.Example.com/A?b") == "com,example)/a?b"
    warc.write_archives(pages.where("false"), str(tmp_path / "e"))
    assert warc.capture_index(spark, str(tmp_path / "e")).count() == 0


def test_large_pages_and_runs_of_several_slices(spark, tmp_path):
    """A page of 50 MB, a URL with most captures, whole rows repeated, ranges smaller than a run."""
    huge = "<p>ä" * 10_000_000
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k % 7}.org/{k}", f"page {k} " + "x" * RNG.randint(0, 2000)) for k in range(3000)] + [(9000, "http://a.org", huge), (9001, "http://b.org", huge)]
    rows += rows[:50]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), size=50_000)
    assert len(glob.glob(str(tmp_path / "w" / "part*"))) > 6
    got = warc.capture_index(spark, str(tmp_path / "w"), range_captures=500).orderBy("seq").collect()
    assert len(got) == len(rows) and Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    order = [warc.capture_key(tuple(r)[2:]) for r in got]
    assert order == sorted(order)
    both = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] >= 9000}
    assert both == {9000: ("revisit", 9001, 50_000_000), 9001: ("response", None, 50_000_000)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        out = stage(spark, out, "/root/testdata/sf0.001").cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and 0 < out.count() <= before, name
    assert out.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in out.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10_001, "", "en", None, 0), (10_002, "日本語" * 50, None, None, None)], base.schema)
    out = base.union(odd).union(base.limit(5))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "/root/testdata/sf0.001").cache()
    ids = {r["doc_id"] for r in out.collect()}
    assert ids and not ids & {None, 10_001, 10_002}
    none = base.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "/root/testdata/sf0.001").cache()
    assert none.count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_pipeline_decides_as_brute_force_does(spark):
    """Deduplication, decontamination and redaction of real rows, copies, a long text and clashing columns."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    own = base.orderBy("doc_id").limit(120)
    long = spark.createDataFrame([(50_001, "quite a long text of many words " * 20_000 + "mail x@y.org", "en", "s", 1), (50_002, own.first()["text"], "en", "s", 1)], base.schema)
    docs = own.union(long).selectExpr("*", "doc_id AS key_1", "'a' AS fp", "2 AS hit_id", "true AS rejected", "doc_id * 2 AS hash").cache()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()

    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    prints = {k: brute_print(t) for k, t in rows.items()}
    ids = sorted(rows)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(components(pairs, ids).values())

    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = low(r["text"])
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    hit = {k for k, t in rows.items() for w in [low(t)] if any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))}
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(rows) - hit and hit

    red = corpus_pipeline.personal_data(spark, docs, sf)
    assert red.columns == docs.columns
    for r in red.collect():
        assert r["n_chars"] == len(r["text"] or "") or r["text"] is None
        assert not pii.base_spans(r["text"] or "") and r["key_1"] == r["doc_id"] and r["hash"] == 2 * r["doc_id"]
        if not pii.proposals(rows[r["doc_id"]] or "")[0] and not pii.proposals(rows[r["doc_id"]] or "")[1]:
            assert r["text"] == rows[r["doc_id"]]
    language = corpus_pipeline.language_id(spark, docs, sf)
    assert language.columns == docs.columns and 50_001 in {r["doc_id"] for r in language.collect()}
    packed = corpus_pipeline.best_fit_packing(spark, red, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(rows)


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
