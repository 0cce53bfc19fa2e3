"""Token ids of whole texts by the tokenizers library, with pre-tokens cached.

The library spends most of its time on words it has met before. Here a text is cut at blanks where a
pre-token ends whatever stands around, each chunk's ids are kept, and only chunks not met before
reach the library: those of plain Latin letters, digits and ASCII signs word by word through the
library's model, all others whole through its encoder. ``encode_all`` takes many texts and merges the
byte pairs of all their new words at once, without the library. Ids equal those of ``Tokenizer.encode`` as the
library is loaded: an added token's string in a text is that token. With ``special_as_text`` it is
ordinary text, as with the library's ``encode_special_tokens``.
"""

from __future__ import annotations

import gc
import json
import os
import re
from struct import pack

import numpy as np
import public_tokenizers

from .common import large

#: Entries of a cache that were met again, and of those met once: some 250 MB for both tokenizer levels.
KEPT, NEW = 600_000, 200_000
#: Bytes of words whose pairs are merged at a time; characters of a longer word, which the library merges,
#: and of a longer text, which is encoded by itself.
MERGED_BYTES, MERGED_CHARS, TOGETHER = 100_000, 100, 4_000_000
#: Words met once that ``encode_all`` lets wait: it needs no chunks beside them.
WAITING = 600_000

#: The split patterns of the two tokenizer files, for ASCII and Latin-1 letters only.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
BYTE_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
PLAIN = re.compile(rf"[\n !-~{LETTERS}]*")
BETWEEN_BLANKS = re.compile(r"\s \s")


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The library's byte-pair merges over many words at a time: in a round every word merges its leftmost
    pair of the least rank. Pairs are found by a hash whose crowded places have a sorted list."""

    SLOTS, NONE = 18, 1 << 30

    def __init__(self, model: dict) -> None:
        vocab, shown = model["vocab"], byte_table()
        self.unit = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.slot, self.crowded = np.zeros(1 << self.SLOTS, np.int32), np.zeros(1 << self.SLOTS, bool)
        at = self.place(self.keys)
        self.slot[at] = np.arange(len(at))
        out = np.flatnonzero(self.slot[at] != np.arange(len(at)))
        self.crowded[at[out]] = True
        self.others = out[np.argsort(self.keys[out])]

    @staticmethod
    def usable(model: dict) -> bool:
        """A plain byte-level model: no options, every byte and merge has one id."""
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in options) or not model["merges"]:
            return False
        pairs = {tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]}
        vocab = model["vocab"]
        return len(pairs) == len(model["merges"]) and max(vocab.values()) < 1 << 20 and all(c in vocab for c in byte_table().values())

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where a pair doesn't merge."""
        sought = left << 20 | right
        at = self.place(sought)
        out = self.slot[at].astype(np.int64)
        wrong = self.keys[out] != sought
        out[wrong] = self.NONE
        if len(self.others) and len(some := np.flatnonzero(wrong & self.crowded[at])):
            other = self.others[np.minimum(np.searchsorted(self.keys[self.others], sought[some]), len(self.others) - 1)]
            out[some] = np.where(self.keys[other] == sought[some], other, self.NONE)
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit bytes; no word is empty."""
        raw = [w.encode() for w in words]
        out: list[bytes] = []
        a = n = 0
        for b, w in enumerate(raw):
            if n + len(w) > MERGED_BYTES and n:
                out += self.some(raw[a:b])
                a, n = b, 0
            n += len(w)
        return out + self.some(raw[a:]) if raw else out

    def some(self, raw: list[bytes]) -> list[bytes]:
        ids = self.unit[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
        rank = np.full(len(ids), self.NONE)  # of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            go = least < self.NONE << 32
            if not go.all():  # words without a pair left
                over = np.repeat(~go, np.diff(np.append(first, len(ids))))
                done.append((word[over], ids[over]))
                at = np.cumsum(~over) - 1
                least = least[go]
                least = least >> 32 << 32 | at[least & 0xFFFFFFFF]
                ids, word, rank = ids[~over], word[~over], rank[~over]
            at = least & 0xFFFFFFFF
            ids[at] = self.merged[least >> 32]
            rank[at] = rank[at + 1]  # NONE where the word ends
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # in every word before one symbol goes
            ids, word, rank = ids[stays], word[stays], rank[stays]
            for x in (at[(at > 0)] - 1, at[at + 1 < len(ids)]):
                x = x[word[x] == word[x + 1]]
                rank[x] = self.ranks(ids[x], ids[x + 1])
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        flat = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(raw))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class _Cache(dict):
    """What was met twice stays; what was met once waits in ``new``, which starts anew when full."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.new.pop(key, None)
        if out is not None:
            if len(self) >= KEPT:
                self.clear()
            self[key] = out
            return out
        out = self.made(key)
        if len(key) < 1000:
            if len(self.new) >= NEW:
                self.new.clear()
            self.new[key] = out
        return out


class _Words(_Cache):
    """Pre-token -> ids as little-endian unsigned 32-bit bytes, through the library's model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.shown = model.tokenize, byte_table()

    def meet(self, unknown: set[str], merges: Merges) -> dict[str, bytes]:
        """Ids of words that aren't here: what was met before comes here, what wasn't waits in ``new``."""
        again = {w: self.new.pop(w) for w in unknown if w in self.new}
        if len(self) + len(again) > KEPT:
            self.clear()
        self.update(again)
        unknown = unknown.difference(again)
        short = [w for w in unknown if len(w) <= MERGED_CHARS]
        fresh = dict(zip(short, merges.ids(short), strict=True))
        if len(self.new) + len(fresh) > WAITING:
            self.new.clear()
        self.new.update(fresh)
        return again | fresh | {w: self.made(w) for w in unknown if len(w) > MERGED_CHARS}

    def made(self, word: str) -> bytes:
        lead = self.shown[0x20] if word[:1] == " " else ""
        body = word[1:] if lead else word
        shown = lead + body if body.isascii() and body.isalnum() else "".join(map(self.shown.__getitem__, word.encode()))
        ids = [t.id for t in self.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)


class _Chunks(_Cache):
    """Chunk -> ids as bytes. lead: what stood before the chunk."""

    def __init__(self, tokenizer, words: _Words, lead: str, lowered: bool) -> None:
        super().__init__()
        self.tokenizer, self.words, self.lead, self.lowered = tokenizer, words, lead, lowered
        self.split = (WORD_PRETOKEN if lowered else BYTE_PRETOKEN).findall

    def made(self, chunk: str) -> bytes:
        text = self.lead + chunk
        if chunk.isascii() and len(chunk) < 1000:  # most chunks: a word, maybe with a sign behind it
            if self.lowered:
                text = text.lower()
            if chunk.isalpha():
                return self.words[text]
            if chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
                return self.words[text[:-1]] + self.words[text[-1]]
        if len(text) < 1000 and PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, self.split(text.lower() if self.lowered else text)))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """encode(text) gives the ids of a whole text as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        t.encode_special_tokens = special_as_text
        self.tokenizer, self.lowered = t, t.normalizer is not None
        self.words = kept = _Words(t.model)
        self.first = _Chunks(t, kept, "", self.lowered)
        self.rest = self.first if self.lowered else _Chunks(t, kept, " ", self.lowered)
        added = {x.content: (i, x) for i, x in t.get_added_tokens_decoder().items() if not (special_as_text and x.special)}
        self.added = {x: pack("<I", i) for x, (i, _) in added.items()}
        self.plain = not any(x.lstrip or x.rstrip or x.single_word or x.normalized for _, x in added.values())
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).finditer
        model = json.loads(t.to_str())["model"] if self.plain and not self.lowered else None
        self.merges = Merges(model) if model and Merges.usable(model) else None

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added) or not self.plain:
            return self.between(text) if self.plain else self.whole(text)
        return self.own(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode of each text; the new pre-tokens of all plain ones are merged together."""
        if self.merges is None:
            return [self.encode(t) for t in texts]
        out: list[bytes] = []
        unsure: list[tuple[int, list[bytes | None], list[tuple[int, str]]]] = []  # texts with words that aren't kept: these
        get = self.words.get
        for k, text in enumerate(texts):
            if len(text) > TOGETHER or not PLAIN.fullmatch(text) or any(x in text for x in self.added):
                out.append(self.encode(text))
                continue
            cut = BYTE_PRETOKEN.findall(text)
            ids = list(map(get, cut))
            if n := ids.count(None):
                at, places = -1, []
                for _ in range(n):
                    at = ids.index(None, at + 1)
                    places.append((at, cut[at]))
                unsure.append((k, ids, places))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        found = self.words.meet({w for _, _, places in unsure for _, w in places}, self.merges)
        for k, ids, places in unsure:
            for at, w in places:
                ids[at] = found[w]
            out[k] = b"".join(ids)
        return out

    def between(self, text: str) -> bytes:
        """A text that holds added tokens: what stands between them is encoded by itself."""
        out, end = [], 0
        for m in self.cut(text):
            out += [self.own(text[end : m.start()]), self.added[m[0]]]
            end = m.end()
        return b"".join(out) + self.own(text[end:])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def own(self, text: str) -> bytes:
        """A text without added tokens."""
        if self.lowered:  # white space is dropped: any blank or line end parts two pre-tokens
            return b"".join(map(self.rest.__getitem__, text.replace("\n", " ").split(" ")))
        # A blank after or before something else begins a pre-token; one between others may not.
        if BETWEEN_BLANKS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it stays between tasks.

    The caches hold no cycles, so the worker's collector needn't walk them as often.
    """
    gc.set_threshold(100_000, 50, 100)
    return large(("encoder", name), lambda: Encoder(name))
