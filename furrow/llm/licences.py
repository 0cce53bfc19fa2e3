"""Licence scan by a positional index of rare words.

Document frequencies of the templates' words over all documents give their IDF. Each template is
indexed at its own highest-IDF words, one more than an alignment that counts may lack, so none escapes
however common its words are. All occurrences of these words in a file look up the postings; hits that
agree on the relative position of file and template are one alignment. An alignment counts when enough
of the template's words stand in place, and its licence when every mandatory key phrase stands within
it, give or take as many words as it may lack. Files where none counts are scored by all words. Base
phrases are found at all their places. Document frequencies only order words: no result depends on them.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, keyed, large, parts, table
from .positional import Shard, byte_words, shards

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences of public licences, with the phrases that must stand in a file.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "licensed under the mit license", ("the mit license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software", "appear in all copies")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2", "except in compliance with the license")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to this work to the public domain worldwide", ("dedicated all copyright", "public domain")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)

#: Share of a template's words that must stand in place; hits of rare words that are aligned at a time.
IN_PLACE, HITS = 0.75, 200_000

OUT_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Rules:
    """Vocabulary, phrases and templates as word numbers."""

    def __init__(self, base: dict[str, str] = BASE, templates=TEMPLATES) -> None:
        self.vocabulary: dict[bytes, int] = {}
        phrase = dict.fromkeys([*base, *chain.from_iterable(m for _, _, m in templates)])
        self.phrases = list(phrase)
        ids = [self.number(p) for p in self.phrases]
        self.by_size = [(n, np.array([k for k, x in enumerate(ids) if len(x) == n])) for n in sorted({len(x) for x in ids})]
        self.rows = {n: np.array([ids[k] for k in at], np.int64) for n, at in self.by_size}
        self.size = np.array([len(x) for x in ids])
        self.base = {self.phrases.index(p): label for p, label in base.items()}
        self.templates = [(label, np.array(self.number(t), np.int64), [self.phrases.index(p) for p in must]) for label, t, must in templates]

    def number(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in byte_words(text)]

    def index(self, df: np.ndarray, n_docs: int) -> None:
        """The postings (word -> template, place) of each template's rarest words, and every word's IDF.

        Of an alignment that counts at least ceil(IN_PLACE * n) of n words stand in place, so one of any
        n - ceil(IN_PLACE * n) + 1 places does.
        """
        self.idf = np.log((1 + n_docs) / (1 + df))
        posts = []
        for t, (_, words, _) in enumerate(self.templates):
            n = len(words) - math.ceil(IN_PLACE * len(words)) + 1
            posts += [(int(words[j]), t, j) for j in np.argsort(-self.idf[words], kind="stable")[:n].tolist()]
        self.posts = np.array(sorted(posts), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.posts[:, 0], np.arange(len(self.vocabulary) + 1))


def document_frequencies(docs: DataFrame, rules: Rules) -> tuple[np.ndarray, int]:
    """How many documents have each licence word, and how many there are. The driver gets a row per word."""
    vocabulary = rules.vocabulary

    def run(batches):
        df, n, known = np.zeros(len(vocabulary), np.int64), 0, vocabulary.keys()
        for batch in batches:
            for t in batch.column(0):
                for w in known & set(byte_words(t.as_py())):
                    df[vocabulary[w]] += 1
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([n], df)))], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return np.array([counts.get(k, 0) for k in range(len(vocabulary))]), counts.get(-1, 0)


def alignments(here: Shard, rules: Rules, places: dict[int, np.ndarray]) -> list[tuple[int, int, float, bool]]:
    """(document, template, share of words in place of the best alignment, whether one counts and holds its
    mandatory phrases) of each file and template that align. places: of each phrase, ascending."""
    used = np.unique(rules.posts[:, 0])
    lens = here.counts[used]
    words = np.repeat(used, lens)
    at = np.concatenate([here.postings[here.first[w] : here.first[w + 1]] for w in used]).astype(np.int64) if len(used) else np.zeros(0, np.int64)
    if not len(at):
        return []
    end = here.ends
    tok = np.full(int(end[-1]), -1, np.int64)
    tok[here.postings] = np.repeat(np.arange(len(here.counts)), here.counts)
    out: dict[tuple[int, int], tuple[float, bool]] = {}
    # Template postings, by relative position; so many hits at a time.
    for a in range(0, len(at), HITS):
        some, own_words = at[a : a + HITS], words[a : a + HITS]
        doc = here.doc(some)
        n = rules.first[own_words + 1] - rules.first[own_words]
        reps = np.repeat(np.arange(len(some)), n)
        post = rules.first[own_words[reps]] + np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)
        found = np.unique(np.stack((rules.posts[post, 1], doc[reps], some[reps] - rules.posts[post, 2]), 1), axis=0)
        for t in np.unique(found[:, 0]).tolist():
            own = found[found[:, 0] == t]
            share, held = judged(own[:, 1], own[:, 2], rules, t, tok, end, places)
            for d, s, h in zip(own[:, 1].tolist(), share.tolist(), held.tolist(), strict=True):
                best, any_held = out.get((d, t), (0.0, False))
                out[d, t] = max(s, best), h or any_held
    return [(d, t, s, h) for (d, t), (s, h) in out.items()]


def judged(docs: np.ndarray, starts: np.ndarray, rules: Rules, t: int, tok: np.ndarray, end: np.ndarray, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shares in place of template t's alignments, and whether they count and hold its mandatory phrases."""
    _, words, must = rules.templates[t]
    low, high = np.concatenate(([0], end[:-1]))[docs], end[docs]
    share = np.zeros(len(docs))
    for j, w in enumerate(words):
        p = starts + j
        ok = (p >= low) & (p < high)
        share[ok] += tok[p[ok]] == w
    share /= len(words)
    held = share >= IN_PLACE
    lack = len(words) - math.ceil(IN_PLACE * len(words))
    for k in must:
        at = places.get(k, np.zeros(0, np.int64))
        first = np.searchsorted(at, np.maximum(starts - lack, low))
        last = np.minimum(starts + len(words) + lack, high) - rules.size[k]
        held &= np.append(at, np.iinfo(np.int64).max)[first] <= last
    return share, held


def best_shares(here: Shard, rules: Rules, docs: np.ndarray) -> np.ndarray:
    """The best share of a template's words in place in each of docs (ascending), by all words."""
    lens, begin = np.diff(here.ends, prepend=0)[docs], np.concatenate(([0], here.ends[:-1]))[docs]
    gap = max((len(words) for _, words, _ in rules.templates), default=0)
    edge = np.cumsum(lens + gap) - lens - gap  # a document's starts, from gap before its first word
    number = np.full(len(here.ends), -1)
    number[docs] = np.arange(len(docs))
    own = number[here.doc(here.postings)]
    kept = np.concatenate(([0], np.cumsum(own >= 0)))[here.first]
    at, own = here.postings[own >= 0].astype(np.int64), own[own >= 0]
    at += edge[own] + gap - begin[own]
    best = np.zeros(len(docs))
    for _, words, _ in rules.templates if len(docs) else ():
        count = np.zeros(int((lens + gap).sum()), np.int32)
        for j, w in enumerate(words.tolist()):
            count[at[kept[w] : kept[w + 1]] - j] += 1
        best = np.maximum(best, np.maximum.reduceat(count, edge) / len(words))
    return best


def _scan(shared):
    def run(batches):
        large()
        rules: Rules = shared.value
        for batch in parts(batches, 1, 2 * PART_BYTES):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, whole in shards(texts):
                here, n = whole.named(rules.vocabulary), b - a
                begin = np.concatenate(([0], here.ends[:-1]))
                base: list[set[str]] = [set() for _ in range(n)]
                places: dict[int, np.ndarray] = {}
                n_base, first, last = [0] * n, [None] * n, [None] * n
                for size, numbers in rules.by_size:
                    at, which = here.find(rules.rows[size])
                    for k in np.unique(which).tolist():
                        places[int(numbers[k])] = np.sort(at[which == k])
                for k, label in rules.base.items():
                    at = places.get(k, np.zeros(0, np.int64))
                    for p, d in zip(at.tolist(), here.doc(at).tolist(), strict=True):
                        w = p - int(begin[d])
                        base[d].add(label)
                        n_base[d] += 1
                        first[d] = w if first[d] is None else min(w, first[d])
                        last[d] = w if last[d] is None else max(w, last[d])
                labels, score = [set(x) for x in base], [1.0 * bool(x) for x in base]
                for d, t, share, held in alignments(here, rules, places):
                    if held:
                        labels[d].add(rules.templates[t][0])
                    score[d] = max(score[d], share)
                left = np.flatnonzero(np.array(score) < IN_PLACE)
                for d, share in zip(left.tolist(), best_shares(here, rules, left).tolist(), strict=True):
                    score[d] = share
                joined = lambda x: [",".join(sorted(y)) for y in x]
                cols = [pa.array(ids[a:b], pa.int64()), pa.array((here.ends - begin).tolist(), pa.int64()), *(pa.array(x, pa.int64()) for x in (n_base, first, last)), pa.array(joined(base)), pa.array(joined(labels)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    A null or empty text has no words, no labels (empty strings) and score zero. Repeated rows each
    give a row. score is 1 with a base phrase, else the best share of a template's words in place.
    """
    rules = Rules(base, templates)
    rules.index(*document_frequencies(docs, rules))
    return keyed(docs, "doc_id").mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(rules)), OUT_SCHEMA)


def op1_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """Base places, and every alignment of every template by all words, in DuckDB's SQL."""
    phrases = list(dict.fromkeys([*BASE, *chain.from_iterable(m for _, _, m in TEMPLATES)]))
    rows = lambda values: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in x) + ")" for x in values)
    lack = lambda n: n - math.ceil(IN_PLACE * n)
    split = [t.split(" ") for _, t, _ in TEMPLATES]
    return rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
template(t, label, n, lack, n_must) AS (VALUES {rows((k, label, len(split[k]), lack(len(split[k])), len(must)) for k, (label, _, must) in enumerate(TEMPLATES))}),
template_word(t, j, word) AS (VALUES {rows((k, j, w) for k, words in enumerate(split) for j, w in enumerate(words))}),
phrase(k, size, word, phrase) AS (VALUES {rows((k, len(x.split(" ")), x.split(" ")[0], x) for k, x in enumerate(phrases))}),
must(t, k) AS (VALUES {rows((k, phrases.index(m)) for k, (_, _, must) in enumerate(TEMPLATES) for m in must)}),
base(k, label) AS (VALUES {rows((phrases.index(x), label) for x, label in BASE.items())}),
words AS (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS word FROM dw),
place AS (SELECT r, k, p, size FROM words JOIN phrase USING (word) JOIN dw USING (r) WHERE array_to_string(w[p + 1:p + size], ' ') = phrase),
aligned AS (SELECT r, t, p - j AS s, count(*) AS c FROM words JOIN template_word USING (word) GROUP BY ALL),
share AS (SELECT r, t, s, n, lack, n_must, label, c / n AS share FROM aligned JOIN template USING (t)),
held AS (
  SELECT r, label FROM share JOIN must USING (t) JOIN place USING (r, k)
  WHERE share >= {IN_PLACE} AND p >= s - lack AND p + size <= s + n + lack
  GROUP BY r, t, s, label HAVING count(DISTINCT k) = any_value(n_must)),
found AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place JOIN base USING (k) GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM held UNION ALL SELECT r, label FROM place JOIN base USING (k)) GROUP BY r),
score AS (SELECT r, max(share) AS score FROM share GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END AS score
FROM dw LEFT JOIN found USING (r) LEFT JOIN labels USING (r) LEFT JOIN score USING (r)
"""


OP1_SQL = oracle_sql()
