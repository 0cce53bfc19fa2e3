"""Personal data by weak supervision.

Regexes propose spans. Labelers vote on each - its shape, gazetteers (mail domains, calling codes,
card prefixes, reserved networks, given names) and the words before it - for, against or not at all.
Expectation-maximisation over the counts of all vote patterns of all documents estimates each labeler's
reliability for each kind; the posteriors train a logistic span classifier, which besides the votes
sees what no labeler does: the span's length and what stands on either side. Spans of the four base
kinds that pass their checks always stay; the classifier decides about the others.

Scanning is linear in a text's length: digits are matched possessively from the start of their run,
and mail addresses outwards from each ``@``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, large, materialize, parts, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "national_id", "iban", "spelled_email", "name")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The method's own proposals.
EXTRA = {
    "local_phone": re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]++)++"),
    "name": re.compile(r"(?:[Mm]y name is|[Ss]igned,|[Dd]ear (?:Mr|Mrs|Ms|Dr)\.?) ([A-Z][a-z]++(?: [A-Z][a-z]++)?)"),
}
#: Calling codes of one to three digits begin with these; card prefixes; networks no person has.
CODES = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9", "21", "22", "23", "24", "25", "26", "29")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65", "22", "35", "36", "30")
RESERVED = ("0.", "127.", "255.")
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum mobi jobs travel tel cat asia post app dev io ai co me tv cc ws xyz online site store shop blog cloud tech club live news email media world life today "
    "de fr es uk it nl eu be ch at se no dk fi pl cz sk hu ro bg gr pt ie lu li is ee lv lt si hr rs ua ru tr il us ca mx br ar cl pe ve au nz jp kr cn tw hk sg my th vn ph id in pk ir ae sa eg za ng ke ma example test".split()
)
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret "
    "anna peter paul maria jose luis carlos ana pierre marie jean claire hans klaus sofia emma lucas julia laura pedro miguel juan antonio francisco isabel carmen lucia elena marta pablo diego jorge sergio andrea marco "
    "giulia francesca luca matteo giovanni chiara louis camille antoine nicolas sophie isabelle jacques michel philippe francois martin stefan andreas wolfgang petra monika sabine ursula heike jens lars sven ingrid astrid "
    "olga ivan dmitri sergei natasha tatiana mehmet ahmed mohammed fatima aisha omar ali hassan yusuf leila amir wei li ming chen yuki hiroshi kenji akira raj priya amit anil sunita kumar alice bob carol emily george "
    "helen henry jack jane kevin kate oliver olivia sam simon steven victoria".split()
)
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "spelled_email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "payment", "pay", "credit"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "reach"),
    "local_phone": ("call", "phone", "tel", "mobile", "fax", "reach"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "account", "transfer", "bank"),
    "name": ("name", "signed", "dear"),
}
AGAINST = ("version", "release", "isbn", "order", "build", "serial", "page", "chapter", "invoice")
#: Characters before a span that the context labelers read.
CONTEXT = 40
LABELERS = ("shape", "gazetteer", "cue", "counter_cue")
#: What a look can be; spans that the reliabilities of all kinds together count for in a kind's own.
LOOKS, STRENGTH = 64, 20.0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses, outwards from each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in BASE, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def extra_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The other proposals, leftmost per kind, that overlap no base span."""
    out = []
    ends = [*accumulate((y for _, _, y in sorted(taken, key=lambda s: s[1])), max)]
    begins = sorted(x for _, x, _ in taken)
    for kind, pattern in EXTRA.items():
        if kind == "spelled_email" and "dot" not in text and "DOT" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if m.re.groups else m.span()
            k = bisect_left(begins, b)  # the base spans that begin before b
            if not k or ends[k - 1] <= a:
                out.append((kind, a, b))
    return out


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 2 for, 0 against, 1 none."""
    value, before = text[a:b], text[max(0, a - CONTEXT) : a].lower()
    words = re.findall(r"[a-z]+", before)
    digits = "".join(c for c in value if "0" <= c <= "9")
    gazetteer, shape = 1, 1
    if kind in ("email", "spelled_email"):
        end = re.split(r"[^A-Za-z0-9-]+", value.rstrip("])"))[-1].lower()
        gazetteer, shape = 2 if end in TOP_DOMAINS else 0, 2 if 2 <= len(end) <= 6 and end.isalpha() else 0
    elif kind == "ip":
        gazetteer, shape = 0 if value.startswith(RESERVED) else 2, 2 if all(str(int(p[-3:])) == p for p in value.split(".")) else 0
    elif kind == "card":
        gazetteer, shape = 2 if digits.startswith(CARD_PREFIXES) else 0, 2 if luhn(digits) else 0
    elif kind in ("phone", "local_phone"):
        gazetteer = (2 if digits.startswith(CODES) else 0) if kind == "phone" else (0 if digits[0] in "01" else 2)
        shape = 2 if not re.search(r"[ .()-]{3}", value) else 0
    elif kind == "national_id":
        gazetteer, shape = 0 if digits[:3] in ("000", "666") or digits[0] == "9" else 2, 2
    elif kind == "iban":
        shape = gazetteer = 2 if iban_valid(value) else 0
    elif kind == "name":
        gazetteer, shape = 2 if value.split(" ")[0].lower() in GIVEN_NAMES else 1, 2 if " " in value else 1
    cue = 2 if any(w in CUES[kind] or any(len(c) > 3 and w.startswith(c) for c in CUES[kind]) for w in words[-5:]) else 1
    counter = 0 if any(w in AGAINST for w in words[-3:]) else 1
    return shape, gazetteer, cue, counter


def look(text: str, a: int, b: int) -> int:
    """What stands before and behind a span (nothing or a line end, blank, letter or digit, other) and its length."""
    side = lambda c: 0 if c in ("", "\n") else 1 if c.isspace() else 2 if c.isalnum() else 3
    return side(text[a - 1 : a]) * 16 + side(text[b : b + 1]) * 4 + (b - a >= 8) + (b - a >= 12) + (b - a >= 20)


def pattern_of(kind: str, vote: tuple[int, ...], seen: int = 0) -> int:
    n = KINDS.index(kind)
    for v in vote:
        n = 3 * n + v
    return n * LOOKS + seen


def votes_of(pattern: int) -> tuple[str, tuple[int, ...]]:
    vote = []
    pattern //= LOOKS
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        vote.append(v)
    return KINDS[pattern], tuple(reversed(vote))


def reliabilities(patterns: list[int], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors by pattern, P(vote | truth) as [kind, labeler, truth, vote]) by expectation-maximisation.

    Each kind has a share of true spans and reliabilities of its own, drawn to those of all kinds together
    by as much as STRENGTH spans would.
    """
    told = [votes_of(p) for p in patterns]
    v = np.array([x for _, x in told], np.int64).reshape(-1, len(LABELERS))
    kind = np.array([KINDS.index(k) for k, _ in told], np.int64)
    post = 1 / (1 + np.exp(-(v - 1).sum(1).astype(float)))
    given = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        share = np.stack(((1 - post) * counts, post * counts))  # [truth, pattern]
        of_kind = np.stack([np.bincount(kind, x, len(KINDS)) for x in share])
        overall = (share.sum(1) + 1) / (counts.sum() + 2)
        prior = (of_kind + STRENGTH * overall[:, None]) / (of_kind.sum(0) + STRENGTH)
        for j, t, x in product(range(len(LABELERS)), (0, 1), range(3)):
            cast = np.bincount(kind, share[t] * (v[:, j] == x), len(KINDS))
            pooled = (cast.sum() + 1) / (share[t].sum() + 3)
            given[:, j, t, x] = (cast + STRENGTH * pooled) / (of_kind[t] + STRENGTH)
        logs = np.log(prior)[:, kind] + sum(np.log(given[kind, j, :, v[:, j]]).T for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return post, given


def features(patterns: list[int]) -> np.ndarray:
    """Kind, votes, votes by kind, look and one."""
    at = np.arange(len(patterns))
    told = [votes_of(p) for p in patterns]
    kind = np.array([KINDS.index(k) for k, _ in told], np.int64)
    vote = np.array([x for _, x in told], np.int64).reshape(-1, len(LABELERS))
    seen = np.array(patterns, np.int64) % LOOKS
    kinds, sides = np.zeros((len(at), len(KINDS))), np.zeros((len(at), 12))
    kinds[at, kind] = 1
    for k, x in enumerate((seen // 16, seen // 4 % 4, seen % 4)):
        sides[at, 4 * k + x] = 1
    both = np.hstack((vote == 2, vote == 0)).astype(float)
    return np.hstack((kinds, both, (kinds[:, :, None] * both[:, None, :]).reshape(len(at), kinds.shape[1] * both.shape[1]), sides, np.ones((len(at), 1))))


def classifier(patterns: list[int], counts: np.ndarray, post: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model of the posteriors, by Newton steps."""
    x = features(patterns)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (post - p)) - ridge * w
        w += np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def accepted_patterns(counts: dict[int, int]) -> frozenset[int]:
    """Patterns of proposals beyond the base kinds that are personal data."""
    if not counts:
        return frozenset()
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    post, _ = reliabilities(patterns, n)
    good = features(patterns) @ classifier(patterns, n, post) > 0
    return frozenset(p for p, g in zip(patterns, good, strict=True) if g and votes_of(p)[0] not in BASE)


FOUND_SCHEMA = "doc_id long, base array<string>, more array<string>, patterns array<int>"


def joined(spans: list[tuple[str, int, int]]) -> list[str]:
    return [f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]


def proposals(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    more = extra_spans(text, base)
    return base, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


def _find(batches):
    """patterns holds those of the base spans first, then those of the others."""
    large()
    for batch in batches:
        base, more, patterns = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            x, y = proposals(text)
            base.append(joined(x))
            more.append(joined(y))
            patterns.append([pattern_of(k, votes(text, k, a, b), look(text, a, b)) for k, a, b in x + y])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(more, pa.list_(pa.string())), pa.array(patterns, pa.list_(pa.int32()))], names=["doc_id", "base", "more", "patterns"])


def _counted(found: DataFrame) -> frozenset[int]:
    """The classifier's accepted patterns; the driver gets a row per pattern, at most 9 * 3^4 * LOOKS."""
    rows = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    return accepted_patterns({r["p"]: r["count"] for r in rows})


OUT_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _decide(good: frozenset[int]):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, base, more, patterns in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n = [sum(s.startswith(f"{k}:") for s in base) for k in BASE]
                kept = [s for s, p in zip(more, patterns[len(base) :], strict=True) if p in good]
                out.append((doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + kept)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(cols)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans for every row of docs.

    A null text is an empty one, without spans. Repeated rows each give a row.
    """
    found = materialize(keyed(docs, "doc_id").mapInArrow(_find, FOUND_SCHEMA))
    return found.mapInArrow(_decide(_counted(found)), OUT_SCHEMA)


def redacted(text: str, good: frozenset[int]) -> str:
    """The text with each span as its kind in angle brackets; overlapping spans as the first one."""
    base, more = proposals(text)
    spans = base + [s for s in more if pattern_of(s[0], votes(text, *s), look(text, *s[1:])) in good]
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def _redact(good: frozenset[int], at: int, name: str):
    def run(batches):
        large()
        for batch in parts(batches, at):
            texts = [t if t is None else redacted(t, good) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, name, pa.array(texts, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced by its kind; a null text stays null.

    Texts are scanned once for the votes and once to replace, so none is shuffled or stored between.
    """
    good = _counted(materialize(keyed(docs, "doc_id").mapInArrow(_find, FOUND_SCHEMA).select("patterns").where(F.size("patterns") > 0)))
    return docs.mapInArrow(_redact(good, docs.columns.index("text"), "text"), docs.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
