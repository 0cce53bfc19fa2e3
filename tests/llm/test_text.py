"""Operators that read texts one by one, against brute force."""

import hashlib
import json
import os
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm import decontam, langid, licences, packing, pii, tokenfile, tokens, wordpiece
from furrow.llm.common import materialize
from furrow.llm.positional import Shard, byte_words
from furrow.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, start string, n_tokens string, labels string, score string, piece string"
RNG = random.Random(7)
SYLLABLES = {"en": "the and ing tion er on th re".split(), "de": "und sch ein ung ä ö lich zu".split(), "fr": "eau les é è que oi ment eur".split()}


def prose(lang: str, n: int) -> str:
    return " ".join("".join(RNG.choices(SYLLABLES[lang], k=RNG.randint(1, 3))) for _ in range(n))


#: Nulls, empty and long texts, repeated rows and columns that clash with results.
ROWS = [
    (1, "Released under the MIT License. Under the mit license, under the MIT license", "en"),
    (2, "", "en"), (3, None, "en"), (4, "   \n\t ", None), (None, "no id here, mail a.b@c.de", "en"), (5, "12345 !!", None),
    (6, "Tel +1 (415) 555-0134, card 4111 1111 1111 1111, host 10.0.0.256 or 10.0.0.25 then x@y.org", "en"),
    (6, "Tel +1 (415) 555-0134, card 4111 1111 1111 1111, host 10.0.0.256 or 10.0.0.25 then x@y.org", "en"),
    (7, "This work is licensed under the GNU General Public License, version 3.", "en"),
    (8, "a  b   c\n\n d日本語 e\x1cf", None), (9, "end <|endoftext|> and<|startoftext|>begin", "en"),
    *((100 + k, prose(lang, 30), lang) for k, lang in enumerate(["en", "de", "fr"] * 40)),
    (900, prose("en", 9000), "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, name):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    alphabet = "ab Zé\n\t  's'll 12,.!?ßḈ 日\x1c\x85µİς"
    texts = ["".join(RNG.choices(alphabet, k=RNG.randint(0, 30))) for _ in range(1500)] + [r[1] or "" for r in ROWS] + ["x<|endoftext|>y", "I'LL he's"]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "e", "é", "a b"]
    texts += ["".join(RNG.choices(parts, k=RNG.randint(1, 8))) for _ in range(1500)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    for as_text in (False, True):
        own, t.encode_special_tokens = Encoder(name, as_text), as_text
        for text in texts * 2:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together_equal_the_library(name, monkeypatch):
    for kept, new, most in ((600_000, 600_000, 100_000), (30, 20, 50)):  # also with caches that overflow
        for k, v in (("KEPT", kept), ("WAITING", new), ("MERGED_BYTES", most)):
            monkeypatch.setattr(tokens, k, v)
        own, t = Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
        alphabet = "abehnortß é'sld\n   1,.!*ÿ"
        texts = ["".join(RNG.choices(alphabet, k=RNG.randint(0, 60))) for _ in range(600)] + [r[1] or "" for r in ROWS]
        texts += ["", "I'll he's 'tis!'s", "日本 abc", "x<|endoftext|>y", "a" * 1500 + " b" * 9, "é" * 99 + " \n" + "-=" * 700]
        for _ in range(3):
            got = own.encode_all(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert own.encode_all([]) == []


def test_new_words_are_merged_without_the_library():
    own = Encoder("byte_bpe_50k.json")
    own.words.tokenize = None
    text = "Reaninwh mitstßß onerré\nof 12, " * 2
    assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == ids_of(text, "byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [8, 5, 1])
@pytest.mark.parametrize("n,most", [(0, 1), (1, 5), (1500, 50257), (700, 2**32 - 1)])
def test_any_token_of_a_segment(bits, n, most):
    ids = np.random.default_rng(1).integers(0, most, n, dtype=np.uint64).astype("<u4")
    s = tokenfile.Segment(tokenfile.write_segment([5, None], np.array([n // 2, n]), ids, bits))
    assert (s.ids() == ids).all() and s.doc_ids == [5, None]
    assert all(s.token(i) == ids[i] for i in range(0, n, 13))
    with pytest.raises(IndexError):
        s.token(n)


def test_token_files(spark, docs, none, tmp_path):
    tokenfile.write_tokens(docs, str(tmp_path / "a"))
    got = sorted((tuple(r) for r in tokenfile.read_tokens(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda k: (k is not None, k))
    at = 0
    texts = {r[0]: r[1] for r in ROWS}
    for doc_id, start, n, crc in got:
        ids = np.array([*ids_of(texts[doc_id], "byte_bpe_50k.json"), 2], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    tokenfile.write_tokens(none, str(tmp_path / "b"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_packing_keeps_every_piece_and_fills_sequences(docs, none):
    got = packing.pack_documents(docs, capacity=512).collect()
    lengths = {}
    for doc_id, text, _ in ROWS:
        ids = np.array([*ids_of(text, "word_bpe_49k.json"), 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            lengths.setdefault((doc_id, k), []).append((a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())))
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in lengths.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(n for v in lengths.values() for _, n, _ in v)
    assert len(sequences) <= -(-total // 512) + 2
    assert packing.pack_documents(none).count() == 0


def test_repeated_pieces_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 250)
    same = materialize(spark.range(4000).selectExpr("cast(null as long) AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "7L AS ids_crc32"))
    groups = packing._round(same, 4000, 512, 0).groupBy(F.shiftright("sequence_id", 25).alias("g")).count().collect()
    assert len(groups) == 16 and sum(r["count"] for r in groups) == 4000 and max(r["count"] for r in groups) < 400


def test_local_search_only_moves_and_empties_bins():
    rng = np.random.default_rng(3)
    for low, high in ((1, 100), (34, 60), (20, 50)):
        n = rng.integers(low, high + 1, 400)
        first, after = packing.best_fit_decreasing(n, 100), packing.pack(n, 100)
        assert sorted(i for b in after for i in b) == list(range(400)) and all(n[b].sum() <= 100 for b in after)
        assert -(-n.sum() // 100) <= len(after) <= len(first)
    search = packing.LocalSearch([[0, 1], [2, 3], [4]], np.array([60, 20, 50, 30, 40]), 100)
    assert len(search.run()) == 2  # 40 goes for 20 beside 60, 20 then beside 50 and 30


def test_no_step_is_left_at_the_end_of_the_local_search():
    rng = np.random.default_rng(9)
    for low, high, n in ((20, 50, 60), (15, 35, 80), (30, 70, 40), (1, 60, 40)):
        lengths = rng.integers(low, high + 1, n)
        bins = packing.LocalSearch(packing.best_fit_decreasing(lengths, 100), lengths, 100).run()
        some = lambda b, k: {sum(lengths[list(c)]) for c in combinations(b, k)}
        full = sorted((int(lengths[b].sum()), k) for k, b in enumerate(bins))
        for i, (_, a) in enumerate(full):
            for fill, b in full[i + 1 :]:
                if fill < 100:
                    assert min(some(bins[a], 1)) > 100 - fill
                    for give, take in ((1, 1), (2, 1), (1, 2)):
                        assert not any(0 < x - y <= 100 - fill for x in some(bins[a], give) for y in some(bins[b], take))


def test_phrases_by_position():
    vocab = ["the", "a", "b", "É", "w1"]
    texts = [" ".join(RNG.choices(vocab, k=RNG.randint(0, 40))) for _ in range(150)] + [None, ""]
    items = [(str(k), byte_words(" ".join(RNG.choices(vocab, k=RNG.choice([1, 2, 3, 5]))))) for k in range(30)]
    w = decontam.Windows(items, 3)
    s = Shard.of(texts)
    here, begin = s.named(w.vocabulary), np.concatenate(([0], s.ends[:-1]))
    words = [byte_words(t) for t in texts]
    name = {v: k for k, v in w.vocabulary.items()}
    for size, phrases, _ in w.by_size:
        at, which = here.find(phrases)
        want = {(int(begin[d]) + k, p) for d, x in enumerate(words) for k in range(len(x) - size + 1) for p, row in enumerate(phrases) if x[k : k + size] == [name[i] for i in row]}
        assert set(zip(at.tolist(), which.tolist(), strict=True)) == want
        loose, _ = here.find(phrases, slop=1)
        assert len(loose) >= len(at)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_contamination(spark, none):
    passage = prose("en", 14)
    rows = [(1, f"x {passage.upper()} y"), (2, "clean text of no item"), (3, None), (4, "Tiny item, TINY ITEM"), (5, " ".join(passage.split()[:9])), (5, passage + "\n" + passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, passage), (9, passage + " more"), (7, "tiny item"), (8, None), (11, "?!")], "item_id long, text string")
    items = [(str(k), WORD.findall(t.translate(ASCII))) for k, t in ((10, passage), (9, passage + " more"), (7, "tiny item"))]
    want = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(ASCII))
        hit, names = set(), set()
        for item, x in items:
            n = min(10, len(x))
            windows = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names.add(item)
        want.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in decontam.contamination(docs, bench).collect()), key=key) == sorted(want, key=key)
    several = decontam.search(decontam.build_index(docs), bench, block_words=5)
    one = decontam.search(decontam.build_index(docs), bench)
    norm = lambda df: sorted((repr(r["doc_id"]), r["n_words"], tuple(r["spans"]), tuple(sorted(r["items"]))) for r in df.collect())
    assert norm(several) == norm(one)
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {2, 3, 5} and decontam.clean(docs, bench).count() == 3
    assert not any(r["contaminated"] for r in decontam.contamination(docs, bench.where("false")).collect())
    assert decontam.contamination(none, bench).count() == 0


def test_items_without_an_id_contaminate_as_in_the_sql(spark):
    duckdb, pa = pytest.importorskip("duckdb"), pytest.importorskip("pyarrow")
    passage, other = prose("en", 14), prose("de", 12)
    rows = [(1, f"x {passage} y"), (2, f"{other} {passage}"), (3, "clean"), (4, None), (5, other)]
    items = [(None, passage), (None, passage + " more"), (7, other), (8, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()], pa.schema([(df.columns[0], pa.int64()), ("text", pa.string())])))
    got = sorted(tuple(r) for r in decontam.contamination(docs, bench).collect())
    assert got == sorted(con.execute(decontam.OP5_SQL).fetchall()) and [r[5] for r in got] == [True, True, False, False, True]
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {3, 4}
    several = decontam.search(decontam.build_index(docs), bench, block_words=5)
    assert {r["doc_id"]: len(r["items"]) for r in several.collect()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 1}


def test_index_rows_are_small_and_long_texts_are_found(spark, monkeypatch):
    """One long text whose commonest word fills several rows, columns that clash, equal and null ids."""
    passage = prose("fr", 12)
    long = ("the " * 150_000) + passage + " the" * 20
    rows = [(1, long, 0, "x", 7, "y"), (1, "clean words", 0, "x", 7, "y"), (None, passage, 0, "x", 7, "y"), (None, "clean too", 0, "x", 7, "y"), (2, None, 0, "x", 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash long, term string, hit_id int, t string")
    bench = spark.createDataFrame([(None, passage, "z"), (3, "the " * 30 + "absent", "z")], "item_id string, text string, hash string")
    index = decontam.build_index(docs)
    assert max(len(r["postings"]) for r in index.select("postings").collect()) == 4 * decontam.ROW_POSTINGS
    assert index.where("term = cast('the' as binary)").agg({"docs": "sum"}).first()[0] == 1
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(docs, bench).collect()}
    assert got[1, 150_032] == (150_032, 2, True)
    assert got[None, 12] == (12, 1, True) and got[1, 2] == got[None, 2] == got[2, 0] == (0, 0, False)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} == {"clean words", "clean too", None}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta x gamma delta"), (3, "alpha x y z beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontam.build_index(docs)
    assert {r["doc_id"] for r in decontam.matches(index, bench, 4).collect()} == {1}
    assert {r["doc_id"] for r in decontam.matches(index, bench, 4, slop=1).collect()} == {1, 2}


def test_licences(docs, none, spark):
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (3, 1, 9, "mit", 1.0)
    assert got[7]["base_labels"] == "" and got[7]["labels"] == "gpl-3" and got[7]["n_base"] == 0 and got[7]["first_word"] is None
    assert got[2]["labels"] == got[3]["labels"] == "" and got[3]["n_words"] == 0 and got[3]["score"] == 0
    assert all(got[k]["labels"] == "" for k in range(100, 220))
    assert licences.scan(docs).count() == len(ROWS) and licences.scan(none).count() == 0
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    more = spark.createDataFrame([(1, prose("en", 50) + " " + bsd + " " + prose("en", 50)), (2, bsd[:40]), (3, "CC-BY-NC"), (4, "cc by\nnc cc by nc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(more).collect()}
    assert got[1]["labels"] == "bsd" and got[2]["labels"] == "" and got[3]["base_labels"] == "cc-by-nc" and (got[4]["n_base"], got[4]["last_word"]) == (2, 3)


def test_common_licences_are_found_like_rare_ones(spark):
    """In small tables, in a table where every row has the text, and the score by all words in place."""
    whole = {label: text for label, text, _ in licences.TEMPLATES[::-1]}
    rows = [(0, whole["bsd"]), (1, "x " + whole["bsd"]), *((k, prose("en", 30)) for k in (2, 3, 4))]
    rows += [(100 + 100 * k + j, f"{prose('en', 20)} {whole[x]}") for k, x in enumerate(("isc", "gpl-2", "cc0")) for j in range(30)]
    rows += [(900, "the following conditions are met of the")]
    for some in (rows[:5], rows[:2], rows):
        got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got[0]["labels"] == got[1]["labels"] == "bsd" and got[1]["score"] == 1
    assert {(k // 100, r["labels"], r["score"]) for k, r in got.items() if 100 <= k < 400} == {(1, "isc", 1.0), (2, "gpl-2", 1.0), (3, "cc0", 1.0)}
    want = max(sum(a == b for a, b in zip(t.split()[max(-s, 0) :], rows[-1][1].split()[max(s, 0) :], strict=False)) / len(t.split()) for _, t, _ in licences.TEMPLATES for s in range(-60, 8))
    assert got[900]["labels"] == "" and got[900]["score"] == pytest.approx(want)


def with_sql(docs, sql):
    """The rows of a query's SQL over docs as the table documents."""
    duckdb, pa = pytest.importorskip("duckdb"), pytest.importorskip("pyarrow")
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.select("doc_id", "text").collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def test_licences_equal_the_sql(spark, docs):
    """Whole and cut templates, words in between, phrases of one licence beside the text of another."""
    pool = [w for _, t, _ in licences.TEMPLATES for w in t.split()]
    rows = []
    for k in range(400):
        _, text, must = RNG.choice(licences.TEMPLATES)
        words = text.split()
        for _ in range(RNG.randint(0, 4)):
            at = RNG.randrange(len(words))
            words[at : at + RNG.randint(0, 2)] = RNG.choices(pool, k=RNG.randint(0, 2))
        parts = [words, prose("en", RNG.randint(0, 20)).split(), RNG.choice([list(must), RNG.choices(pool, k=5), list(licences.BASE)])]
        RNG.shuffle(parts)
        rows.append((k, " ".join(sum(parts, [])[RNG.randint(0, 3) :])))
    key = lambda r: tuple((x is None, x) for x in r)
    for some in (spark.createDataFrame(rows, "doc_id long, text string"), docs):
        names, want = with_sql(some, licences.OP1_SQL)
        got = licences.scan(some).select(*names).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r["labels"] != r["base_labels"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) > 50


def test_phrases_count_within_their_own_alignment(spark):
    texts = {label: t for label, t, _ in licences.TEMPLATES[::-1]}
    cut = texts["gpl-2"].replace("version 2 of the license", "some x of the license")
    rows = [(1, cut), (2, cut + " " + prose("en", 50) + " version 2 of the license"), (3, texts["gpl-2"] + " " + prose("en", 50))]
    got = {r["doc_id"]: r["labels"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "gpl-2"}


def test_every_licence_of_a_file_is_found(spark):
    """A file that holds all templates, among rows in which the words of its last one are the commonest."""
    last = "licensed under the gnu general public license version 3"
    text = " ".join(t for _, t, _ in licences.TEMPLATES if t != last and not t.startswith("this program")) + " " + last
    rows = [(1, text), *((k, f"{' '.join(reversed(last.split()))} {prose('en', 9)}") for k in range(10, 60))]
    got = {r["doc_id"]: r["labels"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(1).split(",") == sorted({label for label, _, _ in licences.TEMPLATES}) and set(got.values()) == {""}


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_regexes():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for alphabet in ("a@.-_%b 1", "0123456789.- +()", "12.@+a "):
        for _ in range(4000):
            t = "".join(RNG.choices(alphabet, k=RNG.randint(0, 45)))
            assert pii.base_spans(t) == brute_pii(t)


def test_long_runs_take_linear_time():
    t = "1" * 200_000 + "a" * 200_000 + "@" + "+1" + " " * 200_000 + "1.2.3"
    assert pii.base_spans(t) == [] and pii.proposals("A1" * 50_000)[1] == []


def test_personal_data(docs, none):
    rows = [r.asDict() for r in pii.find_pii(docs).collect()]
    assert len(rows) == len(ROWS)
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in rows:
        base = pii.joined(brute_pii(text[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and r["spans"].startswith(",".join(base))
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE]
    assert [r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows if r["doc_id"] == 6] == [4, 4]
    assert pii.find_pii(none).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[6] == "Tel <PHONE>, card <CARD>, host 10.0.0.256 or <IP> then <EMAIL>" and red[3] is None and red[100] == text[100]


def test_reliabilities_are_told_apart_by_kind():
    """Shape tells true spans of one kind and nothing about those of another."""
    rng, counts = np.random.default_rng(8), Counter()
    for kind, good in (("iban", 0.97), ("national_id", 0.5)):
        for _ in range(4000):
            true = rng.random() < 0.4
            votes = [2 * (true if rng.random() < x else not true) for x in (good, 0.9)] + [2 if true and rng.random() < 0.6 else 1, 0 if not true and rng.random() < 0.4 else 1]
            counts[pii.pattern_of(kind, tuple(int(v) for v in votes))] += 1
    _, given = pii.reliabilities(list(counts), np.array(list(counts.values()), float))
    iban, number = (given[pii.KINDS.index(k)][0] for k in ("iban", "national_id"))
    assert iban[1, 2] > 0.9 and iban[0, 0] > 0.9 and 0.4 < number[1, 2] < 0.6 and 0.4 < number[0, 0] < 0.6


def iban_of(country, body):
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def planted_pii(n):
    """(text, true spans): personal data among look-alikes that are none."""
    digits = lambda k: "".join(RNG.choices("23456789", k=k))
    word = lambda: "".join(RNG.choices("abcdefgh", k=RNG.randint(4, 9)))
    names = sorted(pii.GIVEN_NAMES)
    for _ in range(n):
        parts, spans = [], set()
        for kind in RNG.sample(["national_id", "iban", "local_phone", "spelled_email", "name"], 3):
            real = RNG.random() < 0.5
            before, value = {
                "national_id": lambda: (RNG.choice(["my ssn ", "social security "]), f"{RNG.choice('345')}{digits(2)}-{digits(2)}-{digits(4)}") if real else (RNG.choice(["order ", "part serial "]), f"{RNG.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"),
                "iban": lambda: ("iban ", iban_of("DE", digits(18))) if real else ("build ", f"DE{digits(2)}{digits(18)}"),
                "local_phone": lambda: (RNG.choice(["call ", "phone "]), f"{digits(3)}-{digits(3)}-{digits(4)}") if real else ("release ", f"1{digits(2)} {digits(3)} {digits(4)}"),
                "spelled_email": lambda: (RNG.choice(["write to ", "contact "]), f"{word()} [at] {word()} [dot] {RNG.choice(['com', 'org', 'de'])}") if real else ("page ", f"{word()} (at) {word()} (dot) {word()}9"),
                "name": lambda: ("my name is ", f"{RNG.choice(names).title()} {word().title()}") if real else ("version signed, ", word().title()),
            }[kind]()
            at = sum(map(len, parts)) + len(before) + 2 * len(parts)
            if real:
                spans.add(f"{kind}:{at}:{at + len(value)}")
            parts.append(before + value)
        yield ". ".join(parts), spans


def test_added_spans_are_mostly_right_and_mostly_all(spark):
    rows = list(planted_pii(1500))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    right = Counter()
    for r in pii.find_pii(docs).collect():
        got = {x for x in r["spans"].split(",") if x and x.split(":")[0] not in pii.BASE}
        want = rows[r["doc_id"]][1]
        right.update(found=len(got), true=len(want), both=len(got & want))
    assert right["both"] >= 0.9 * right["found"] and right["both"] >= 0.9 * right["true"], right


def test_overlaps_with_many_base_spans_take_linear_time():
    t = "a@b.c my ssn 123-45-6789 " * 20_000
    began = time.time()
    base, more = pii.proposals(t)
    assert len(base) == len(more) == 20_000 and time.time() - began < 10
    assert [s[0] for s in pii.extra_spans("call 415-555-0134", [("phone", 5, 9)])] == []


def test_labelers_of_known_reliability_are_told_apart():
    rng, counts = np.random.default_rng(5), {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = tuple(int(v) for v in [2 * (true if rng.random() < 0.95 else not true), 2 * (true if rng.random() < 0.6 else not true), 2 if true and rng.random() < 0.5 else 1, 0 if not true and rng.random() < 0.3 else 1])
        p = pii.pattern_of("national_id", vote)
        counts[p] = counts.get(p, 0) + 1
    post, given = pii.reliabilities(list(counts), np.array(list(counts.values()), float))
    given = given[pii.KINDS.index("national_id")]
    assert given[0][1, 2] > 0.85 and given[1][1, 2] < 0.75 and given[0][0, 0] > 0.85
    good = pii.accepted_patterns(counts)
    assert pii.pattern_of("national_id", (2, 2, 2, 1)) in good and pii.pattern_of("national_id", (0, 0, 1, 0)) not in good
    assert pii.accepted_patterns({}) == frozenset() and pii.votes_of(pii.pattern_of("iban", (0, 1, 2, 1))) == ("iban", (0, 1, 2, 1))


def test_language_model_is_a_distribution():
    counts = {x: langid.summed(np.concatenate([langid.grams(prose(x, 200)) for _ in range(5)])) for x in SYLLABLES}
    m = langid.Model.build(counts)
    for ctx in (m.grams[4][10] >> np.uint64(16), np.uint64(0x4E00_4E00_4E00)):
        keys = (ctx << np.uint64(16)) | m.grams[1]
        rest = m.scores(np.array([(ctx << np.uint64(16)) | np.uint64(0x4E01)], np.uint64))
        assert (2.0 ** m.scores(keys)).sum(0) + 2.0 ** rest[0] == pytest.approx(1, abs=1e-4)


def brute_kneser_ney(texts):
    """P(unit | three before) by the formula, over dictionaries: (probability function, known units)."""
    padded = ["   " + "".join(chr(x) for x in (langid.grams(t) & np.uint64(0xFFFF)).tolist()) for t in texts]
    counts = {4: Counter(t[k : k + 4] for t in padded for k in range(len(t) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, total, kinds = {}, {}, {}
    for n, c in counts.items():
        once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        cut[n] = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, x in c.items():
            total[n][g[:-1]] += x
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        if not total[n][gram[:-1]]:
            return p(gram[1:])
        below = cut[n] * kinds[n][gram[:-1]] / total[n][gram[:-1]] * p(gram[1:])
        return max(counts[n][gram] - cut[n], 0) / total[n][gram[:-1]] + below

    return p, padded


def test_language_model_equals_the_formula(spark):
    """From arrays and from a table, for seen and unseen grams."""
    texts = [prose("fr", 40) for _ in range(6)] + ["aaa bbb", "a"]
    p, padded = brute_kneser_ney(texts)
    built = langid.Model.build({"fr": langid.summed(np.concatenate([langid.grams(t) for t in texts]))})
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1 and zlib.crc32(str(k).encode()) // 3 % langid.CALIBRATION_PART][: len(texts)]
    trained = langid.train(spark.createDataFrame([(k, t, "fr") for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string"))
    sought = sorted({t[k : k + 4] for t in padded for k in range(len(t) - 3)})[::5] + ["zzzz", "eau?", "e qu", "lesz", "日本語文", "  a日"]
    keys = np.array([int.from_bytes(g.encode("utf-16-be"), "big") for g in sought], np.uint64)
    for m in (built, trained):
        assert 2.0 ** m.scores(keys)[:, 0] == pytest.approx([p(g) for g in sought], rel=1e-4)


def test_three_hundred_labels_are_learned(spark):
    letters = [chr(0x4E00 + k) for k in range(600)]
    rows = [(12 * j + k, " ".join(RNG.choices(letters[2 * j], k=9) + RNG.choices(letters[2 * j + 1], k=9)), f"x{j:03}") for j in range(300) for k in range(12)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] for r in rows}
    assert len({r["lang_pred"] for r in got}) == 300 and sum(want[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.98 * len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't here")
def test_held_out_accuracy_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r["lang_pred"] == r["lang"])
    assert len(by) > 2 and all(len(x) > 20 and np.mean(x) >= 0.95 for x in by.values()), {k: (len(x), np.mean(x)) for k, x in by.items()}


def test_languages(docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    for doc_id, text, lang in ROWS:
        r = by[doc_id]
        assert r["held_out"] == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" and r["rejected"]
        elif doc_id and doc_id >= 100:
            assert r["lang_pred"] == lang and not r["rejected"]
    assert langid.identify(none).count() == 0
    kept = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert {2, 3, 4, 5}.isdisjoint(kept) and set(range(100, 220)) <= kept
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.identify(unknown).collect()} == {"und"}
    small = langid.train(docs, max_grams=100)
    assert small.langs == ["de", "en", "fr"] and 0 < len(small.grams[4]) <= 300
    foreign = docs.selectExpr("doc_id", "repeat('日本語の文章です。', 20) as text", "lang")
    assert langid.identify(foreign, langid.train(docs)).where("not rejected").count() == 0


def test_cut_language_models_keep_what_all_grams_tell(spark, docs):
    """The limit is filled although a count level straddles it, and the rest of the mass goes to lower orders."""
    full, cut = langid.train(docs, max_grams=10**6), langid.train(docs, max_grams=300)
    assert len(full.grams[4]) > 900 and cut.letters == full.letters and (cut.grams[1] == full.grams[1]).all()
    assert cut.logp[1] == pytest.approx(full.logp[1], abs=1e-5)
    one = langid.train(docs.where("lang = 'de'"), max_grams=300)
    assert len(one.grams[4]) == 300 == min(300, len(langid.train(docs.where("lang = 'de'")).grams[4]))
    for ctx in (cut.grams[4][10] >> np.uint64(16), cut.grams[4][-1] >> np.uint64(16)):
        keys = (ctx << np.uint64(16)) | cut.grams[1]
        rest = cut.scores(np.array([(ctx << np.uint64(16)) | np.uint64(0x4E01)], np.uint64))
        assert (2.0 ** cut.scores(keys)).sum(0) + 2.0 ** rest[0] == pytest.approx(1, abs=1e-4)
    singles = spark.createDataFrame([(k, "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(9)), "xx") for k in range(20)], "doc_id long, text string, lang string")
    assert len(langid.train(singles, max_grams=20).grams[4]) == 20


def test_language_blocks_score_like_one_array():
    counts = {x: langid.summed(np.concatenate([langid.grams(prose(x, 100)) for _ in range(3)])) for x in SYLLABLES}
    one = langid.Model.build(counts)
    of = langid.Model.of
    try:
        langid.Model.of = classmethod(lambda cls, t, cells=1: of(t, cells=1))
        several = langid.Model.build(counts)
    finally:
        langid.Model.of = of
    assert len(several.further) == 2 and several.langs == one.langs
    texts = [prose(x, 20) for x in SYLLABLES] + ["日本 zzz"]
    assert several.entropies(texts)[0] == pytest.approx(one.entropies(texts)[0], abs=1e-4)


def test_texts_of_an_unlearned_language_are_rejected(spark, docs):
    """In the learned script and with the learned letters, but other words; those of learned languages pass."""
    syllables = "ää yy kk mi hei lla ssä jo ven".split()
    rows = [(k, " ".join("".join(RNG.choices(syllables, k=RNG.randint(1, 3))) for _ in range(60)), None) for k in range(20)]
    rows += [(1000 + k, prose(x, 60), None) for k, x in enumerate(["en", "de", "fr"] * 10)]
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[k]["rejected"] for k in range(20)) and not any(got[k]["rejected"] for k in range(1000, 1030))


def greedy(word, initial, inner):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (inner if i else initial)), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    for _ in range(800):
        some = lambda k: {bytes(RNG.choices(b"abc", k=RNG.randint(1, 4))) for _ in range(k)}
        initial, inner = some(RNG.randint(1, 8)), some(RNG.randint(1, 8))
        a = wordpiece.Automaton(list(initial), list(inner))
        for _ in range(10):
            w = bytes(RNG.choices(b"abc", k=RNG.randint(1, 10)))
            assert a.count(w) == greedy(w, initial, inner)


def test_token_counts(docs, none, tmp_path):
    initial, inner = map(set, wordpiece.vocabulary())
    for r in wordpiece.token_counts(docs).collect():
        text = {x[0]: x[1] for x in ROWS}[r["doc_id"]] or ""
        words = text.encode().split()
        assert r["n_words"] == len(words) and r["n_unknown"] == 0 and r["n_tokens"] == sum(greedy(b" " + w, initial, inner) for w in words)
    assert wordpiece.token_counts(none).count() == 0
    (tmp_path / "v.json").write_text(json.dumps({"added_tokens": [], "model": {"vocab": {"Ġa": 0, "b": 1}}}))
    r = wordpiece.token_counts(docs.selectExpr("doc_id", "'abb axb b a' as text").limit(1), str(tmp_path / "v.json")).first()
    assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (4, 6, 2)
