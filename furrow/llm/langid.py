"""Language identification by interpolated Kneser-Ney character models.

Counts of character 4-grams come from every labelled row outside the held-out third, summed per
partition before the shuffle. Continuation counts, discounts and totals come from all of them; then
each order keeps its most frequent, and what the others held goes to the order below. A 4-gram of 16-bit
units is packed into one unsigned 64-bit number, a hash without collisions; the models of a block of
languages share sorted arrays of these numbers, one per order, with a column of log probabilities per
language. A text's score in a language is its
cross-entropy a character; the lowest wins. A small part of the labelled rows stays out of the counts
and calibrates the posterior's temperature and the bound beyond which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large, materialize, parts, slices, table

UNKNOWN = "und"
#: Bounds of the model: n-grams a language and order (the most frequent; the rest of the mass backs off),
#: probabilities in the shared arrays of a block: with more, languages share arrays in smaller blocks.
GRAMS, CELLS = 200_000, 8_000_000
#: Characters beyond which a text's score grows no surer: neighbouring characters tell much the same.
EVIDENCE = 200
#: One labelled row in so many is kept for calibration, and so many rows at most.
CALIBRATION_PART, CALIBRATION_ROWS = 32, 4000
#: Share of a language's calibration texts that its bound lets pass at least; share of the texts of other
#: languages that count as strays when the bound is set below them; bits a character above the first
#: where there is no other language; bits that a text of one character may lie above the bound, falling
#: with the root of the length.
PASSING, STRAYS, MARGIN, SLACK = 0.999, 0.05, 1.5, 4.0
LETTER = regex.compile(r"\p{L}")
MASKS = {n: np.uint64((1 << 16 * n) - 1) for n in (1, 2, 3)}


def units_table() -> np.ndarray:
    """16-bit unit -> its lower-case letter; a space for what is no letter; halves of pairs stay."""
    out = np.full(65536, 32, np.uint16)
    for u in range(65536):
        if 0xD800 <= u < 0xE000:
            out[u] = u
        elif (c := chr(u)).isalpha():
            out[u] = ord(c.lower()) if len(c.lower()) == 1 else u
    return out


_UNITS: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """The text's 4-grams, one a character: lower-case letters, whatever stands between as one space."""
    if not _UNITS:
        _UNITS.append(units_table())
    u = _UNITS[0][np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")]
    blank = u == 32
    u = u[~(blank & np.concatenate(([True], blank[:-1])))] if len(u) else u
    u = np.concatenate((np.full(3, 32, np.uint64), u.astype(np.uint64)))
    return u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


def _counts(batches):
    large()
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in parts(batches, 0):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            for lang in set(langs[a:b]):
                own = [grams(t) for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang]
                k, c = summed(np.concatenate(own))
                if lang in kept:
                    k, c = summed(np.concatenate((kept[lang][0], k)), np.concatenate((kept[lang][1], c)))
                kept[lang] = k, c
    for lang, (k, c) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def lookup(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in sorted keys, whether found)."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5


@dataclass
class Model:
    """grams[n], logp[n]: sorted n-grams and their log2 probabilities by language; contexts[n],
    back[n]: sorted (n-1)-grams and the log2 weight left to the order below; unseen: log2 probability
    of a character that no language has. letters: how many characters the languages have. The arrays
    are those of the first block of langs; further: the models of the other blocks."""

    langs: list[str]
    grams: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    back: dict[int, np.ndarray]
    unseen: np.ndarray
    letters: int = 0
    temperature: float = 1.0
    bounds: np.ndarray | None = None
    further: tuple[Model, ...] = ()

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """From all 4-grams and their counts by language."""
        tables: dict[str, dict[int, tuple]] = {}
        for lang, (keys, n) in counts.items():
            tables[lang] = {}
            for k in (4, 3, 2, 1):  # below the fourth continuation counts: how many units stand before
                if k < 4:
                    keys, n = summed(keys & MASKS[k])
                _, at = np.unique(keys >> np.uint64(16), return_inverse=True)
                tables[lang][k] = keys, n, np.bincount(at, n)[at], discount(int((n == 1).sum()), int((n == 2).sum()))
        return cls.of(tables)

    @classmethod
    def of(cls, tables: dict[str, dict[int, tuple]], cells: int = CELLS) -> Model:
        """tables[language][order]: the kept grams, their counts, the totals of their contexts and the discount."""
        langs = sorted(tables)
        letters = len(np.unique(np.concatenate([tables[x][1][0] for x in langs]))) if langs else 0
        width = max(1, cells // max(1, sum(len(tables[x][k][0]) for x in langs for k in (1, 2, 3, 4))))
        blocks = [cls.block({x: tables[x] for x in langs[a : a + width]}, letters) for a in range(0, max(1, len(langs)), width)]
        first = blocks[0]
        first.langs, first.further = langs, tuple(blocks[1:])
        return first

    @classmethod
    def block(cls, tables: dict[str, dict[int, tuple]], letters: int) -> Model:
        langs = sorted(tables)
        union = {k: np.unique(np.concatenate([tables[x][k][0] for x in langs])) if langs else np.zeros(0, np.uint64) for k in (1, 2, 3, 4)}
        m, size = cls(langs, union, {}, {}, {}, np.zeros(len(langs)), letters), letters + 1
        for k in (1, 2, 3, 4):
            ctx = np.unique(union[k] >> np.uint64(16))
            p, back = np.zeros((len(union[k]), len(langs))), np.ones((len(ctx), len(langs)))
            below = 2.0 ** m.scores(union[k] & MASKS[k - 1], k - 1) if k > 1 else np.full_like(p, 1 / size)
            for j, lang in enumerate(langs):
                keys, n, total, cut = tables[lang][k]
                held = np.maximum(n - cut, 0) / total
                own, at = np.unique(keys >> np.uint64(16), return_inverse=True)
                where, _ = lookup(ctx, own)
                back[where, j] = np.maximum(1 - np.bincount(at, held, len(own)), 1e-12)
                c = np.zeros(len(union[k]))
                c[lookup(union[k], keys)[0]] = held
                p[:, j] = c + back[lookup(ctx, union[k] >> np.uint64(16))[0], j] * below[:, j]
            m.logp[k], m.contexts[k], m.back[k] = np.log2(p).astype(np.float32), ctx, np.log2(back).astype(np.float32)
            if k == 1 and len(ctx):
                m.unseen = m.back[1][0] - np.log2(size)
        return m

    def scores(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        """log2 probabilities (n, languages of the first block) of each gram's last unit after the others."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(keys), len(self.unseen)))
        at, found = lookup(self.grams[order], keys)
        if not len(self.grams[order]):
            return np.broadcast_to(self.unseen, (len(keys), len(self.unseen)))
        out = self.logp[order][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            lower = self.scores(keys[miss] & MASKS[order - 1] if order > 1 else keys[miss], order - 1)
            if order > 1:
                c, known = lookup(self.contexts[order], keys[miss] >> np.uint64(16))
                lower = lower + np.where(known[:, None], self.back[order][c], 0)
            out[miss] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character by language, characters) of whole texts; a text of none has zero."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in slices(texts, 500_000):
            own = [grams(t) for t in texts[a:b]]
            n[a:b] = [len(g) for g in own]
            have = np.flatnonzero(n[a:b])
            if len(have) and self.langs:
                begin = np.cumsum(n[a:b]) - n[a:b]
                keys = np.concatenate(own)
                sums = np.hstack([np.add.reduceat(b.scores(keys), begin[have], axis=0, dtype=np.float64) for b in (self, *self.further)])
                out[a + have] = -sums / n[a + have][:, None]
        return out, n

    def posterior(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = -bits * np.minimum(n, EVIDENCE)[:, None] / self.temperature
        x = np.exp((x - x.max(axis=1, keepdims=True)) * np.log(2))
        return x / x.sum(axis=1, keepdims=True)

    @property
    def uniform(self) -> float:
        """Bits a character where every known one is as likely: a text above tells of no language."""
        return float(np.log2(self.letters + 1))

    def rejected(self, bits: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        bound = np.full(len(self.langs), self.uniform) if self.bounds is None else self.bounds
        return bits[np.arange(len(bits)), best] > bound[best] + SLACK / np.sqrt(np.maximum(n, 1))

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature of the least log loss, and bounds from labelled texts outside the counts.

        A language's bound lies halfway from the bits of its own texts to those of texts whose own
        language is left out and which then come out as this one, but never below its own texts.
        A language without such texts takes those of all languages.
        """
        known = {x: j for j, x in enumerate(self.langs)}
        rows = [(t, known[x]) for t, x in zip(texts, langs, strict=True) if x in known]
        self.bounds = np.full(len(self.langs), self.uniform)
        if not rows:
            return
        bits, n = self.entropies([t for t, _ in rows])
        true, have = np.array([j for _, j in rows]), n > 0
        loss = {}
        for t in 2.0 ** np.arange(-2, 8):
            self.temperature = t
            loss[t] = -np.log(np.maximum(self.posterior(bits[have], n[have])[np.arange(have.sum()), true[have]], 1e-12)).mean() if have.any() else 0
        self.temperature = min(loss, key=loss.get)
        if not have.any():
            return
        bits, true = bits[have] - SLACK / np.sqrt(n[have])[:, None], true[have]
        at = np.arange(len(true))
        mine = bits[at, true].copy()
        bits[at, true] = np.inf
        nearest, strange = bits.argmin(axis=1), bits.min(axis=1)
        for j in range(len(self.langs)):
            own, other = (x[y == j] if (y == j).any() else x for x, y in ((mine, true), (strange, nearest)))
            top = np.quantile(own, PASSING)
            self.bounds[j] = max(top, (top + np.quantile(other, STRAYS)) / 2) if len(self.langs) > 1 else top + MARGIN


def split_third(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary"))


def _fill(grams: DataFrame, quota: dict[str, int]) -> dict[str, int]:
    """The quota-th gram of each language in signed order, found 16 bits at a time without a sort."""
    left, prefix = dict(quota), dict.fromkeys(quota, 0)
    for shift in (48, 32, 16, 0):
        known = F.create_map(*[F.lit(v) for x, p in prefix.items() for v in (x, p)])[F.col("lang")]
        some = grams if shift == 48 else grams.where(F.shiftright("gram", shift + 16) == known)
        digit = F.shiftright("gram", shift) if shift == 48 else F.shiftright("gram", shift).bitwiseAND(0xFFFF)
        by: dict[str, list[tuple[int, int]]] = {x: [] for x in quota}
        for r in some.groupBy("lang", digit.cast("long").alias("digit")).count().collect():
            by[r["lang"]].append((r["digit"], r["count"]))
        for x, digits in by.items():
            for d, n in sorted(digits):
                if left[x] <= n:
                    prefix[x] = (prefix[x] << 16) + d
                    break
                left[x] -= n
    return prefix


def _tables(counts: DataFrame, langs: list[str], limit: int) -> dict[str, dict[int, tuple]]:
    """What Model.of takes, from all 4-grams: counts, discounts and totals of every order are those of
    all its grams; of these each language keeps the limit most frequent, by count to a sixteenth of a
    power of two and then by gram. All single units stay."""
    tables: dict[str, dict[int, tuple]] = {x: {} for x in langs}
    level, of = F.floor(F.log2("n") * 16), lambda by: F.create_map(*[F.lit(v) for kv in by.items() for v in kv])[F.col("lang")]
    for k in (4, 3, 2, 1):
        if k < 4:
            counts = materialize(counts.groupBy("lang", F.col("gram").bitwiseAND(int(MASKS[k])).alias("gram")).agg(F.count("*").alias("n")))
        held, once, twice = {x: [0] * 1024 for x in langs}, dict.fromkeys(langs, 0), dict.fromkeys(langs, 0)
        for r in counts.groupBy("lang", level.alias("level")).agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect():
            held[r["lang"]][r["level"]] += r["kinds"]
            once[r["lang"]] += r["once"]
            twice[r["lang"]] += r["twice"]
        most = limit if k > 1 else 1 << 16
        upward = {x: [*accumulate(h[::-1])][::-1] + [0] for x, h in held.items()}  # grams of a level or above
        cut = {x: next(j for j, n in enumerate(h) if n <= most) for x, h in upward.items()}
        keep = level >= of(cut)
        quota = {x: most - upward[x][j] for x, j in cut.items() if j and most > upward[x][j]}
        if quota:  # the level that only a part of fits
            under = counts.where(F.col("lang").isin(list(quota)) & (level == of(cut) - 1))
            keep = keep | ((level == of(cut) - 1) & F.coalesce(F.col("gram") <= of(_fill(under, quota)), F.lit(False)))
        ctx = F.shiftrightunsigned("gram", 16).alias("ctx")
        total = counts.groupBy("lang", ctx).agg(F.sum("n").alias("total"))
        kept = counts.where(keep).select("lang", "gram", "n", ctx).join(total, ["lang", "ctx"]).select("lang", "gram", "n", "total").toArrow()
        lang, gram, n, total = (kept.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n", "total"))
        for x in langs:
            own = lang == x
            tables[x][k] = gram[own].view(np.uint64), n[own], total[own], discount(once[x], twice[x])
    return tables


def train(docs: DataFrame, max_grams: int = GRAMS) -> Model:
    """A calibrated model from the rows of docs with a language and crc32(doc_id) mod 3 other than 1.

    Rows with a null doc_id, text or lang teach nothing. No labelled row: a model without languages. Every
    label is learned, so the model grows with them, by max_grams of each order at most. A label of too few
    rows has no text set aside and takes the calibration of the others.
    """
    rest = split_third("doc_id")
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), rest.alias("h")).where("text is not null and lang is not null and h % 3 <> 1")
    aside = F.floor(F.col("h") / 3) % CALIBRATION_PART == 0
    counts = materialize(labelled.where(~aside).select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model.build({})
    m = Model.of(_tables(counts, langs, max_grams))
    sample = labelled.where(aside).orderBy("h").limit(CALIBRATION_ROWS).select("text", "lang")
    rows = sample.mapInArrow(_ordinary, "text string, lang string").collect()
    m.calibrate([r["text"] for r in rows], [r["lang"] for r in rows])
    return m


def _ordinary(batches):
    """Calibration texts of ordinary size only: the driver holds them all."""
    for batch in batches:
        yield batch.filter(pa.array([len(t) <= 20_000 for t in batch.column(0).to_pylist()]))


PRED_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, bits double"


def _predict(shared):
    def run(batches):
        large()
        m: Model = shared.value
        for batch in parts(batches, 2):
            texts = batch.column(2).to_pylist()
            letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
            names, score, out, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
            at = np.flatnonzero(letters)
            if len(at) and m.langs:
                h, n = m.entropies([texts[k] for k in at])
                best, p = h.argmin(axis=1), m.posterior(h, n)
                score[at], bits[at], out[at] = p.max(axis=1), h.min(axis=1), m.rejected(h, n, best)
                for k, j in zip(at, best, strict=True):
                    names[k] = m.langs[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(out), pa.array(bits)], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "bits"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, bits for every row of docs.

    A null text, or one without a letter, is ``und`` and rejected with score zero; so are all where no
    language was learned. A text whose bits a character exceed the calibrated bound keeps its best
    language, but is rejected. held_out is false for a null doc_id. Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    held = F.coalesce(split_third("doc_id") % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), PRED_SCHEMA)


def _accepted(shared, names: list[str]):
    def run(batches):
        large()
        m: Model = shared.value
        for batch in parts(batches, names.index("text")):
            texts = batch.column(names.index("text")).to_pylist()
            keep = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
            at = np.flatnonzero(keep)
            if len(at) and m.langs:
                h, n = m.entropies([texts[k] for k in at])
                keep[at] = ~m.rejected(h, n, h.argmin(axis=1))
            yield batch.filter(pa.array(keep if m.langs else np.zeros(len(texts), bool)))

    return run


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that identification doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(_accepted(shared, docs.columns), docs.schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
