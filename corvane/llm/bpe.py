"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A round looks at all symbols of many words in one flat array. The rank of every adjacent pair is found by binary search
over the sorted pair keys; each word merges the occurrences of its lowest-ranked pair, left to right. A merge makes
pairs of higher rank only, so this equals merging one pair at a time. A worker remembers the ids of a bounded number of
words; only new words enter the rounds. No shuffle: every document is encoded where it is read.

The vocabulary file is a parameter. The driver reads it once and broadcasts its tables, whose size the vocabulary bounds.

Cases: a null text is empty and has no ids; an added token's own text becomes its id; a text of one long word takes
part like any other; repeated rows give repeated results; other columns are not looked at.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_rows, runs_of

#: The split of byte-level BPE into words; must match the vocabulary's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
CACHE_UNITS = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE file: sorted pair keys with rank and result, bytes of each id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.size = max([*ids.values(), *added.values()]) + 1
        self.first = np.array([ids.get(s, -1) for s in symbols], np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        pieces = [b""] * self.size
        for s, i in ids.items():
            pieces[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        for s, i in added.items():
            pieces[i] = s.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.added = added

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        """A vocabulary from the tables of another, as they are broadcast."""
        made = cls.__new__(cls)
        made.__dict__.update(tables)
        return made

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and the offsets of the words in it."""
        counts = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        done_symbols, done_owner = [], []
        while len(symbols):
            same = owner[:-1] == owner[1:]
            key = np.where(same, symbols[:-1] * self.size + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], NONE), NONE)
            heads = np.flatnonzero(np.append(True, ~same))
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(symbols))))
            over = lowest == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            hit = np.flatnonzero((rank == lowest) & ~over)
            # Of pairs that overlap in a row (x x x), every second one counts, from the left.
            run = np.append(True, np.diff(hit) != 1) if len(hit) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, hit, 0)) if len(hit) else hit
            hit = hit[(hit - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.made[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(words)), out=offsets[1:])
        return symbols[order], offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each of many sequences of ids."""
        return pieces(self.flat, self.starts, self.lengths, ids, offsets)


def pieces(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The entries of a flat table that the ids of each sequence name, joined."""
    own = lengths[ids]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(own, out=ends[1:])
    whole = ragged(flat, starts[ids], own).tobytes()
    cuts = ends[offsets].tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start : start + length]``, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


class Encoder:
    """Encodes texts with one vocabulary; remembers a bounded number of units (all their ids in one flat array).

    A unit is what stands between two single spaces, taken with the space before it: words never reach over such a
    space. The first unit of a text, and texts with other spacing or added tokens, go word by word.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        specials = sorted(vocabulary.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else lambda t: [t]
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        added = self.vocabulary.added
        if not any(s in text for s in added):
            return self.find(text)
        return [w for part in self.split(text) for w in ([part] if part in added else self.find(part))]

    def direct(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of groups of words in one flat array, and the offsets of the groups."""
        added = self.vocabulary.added
        distinct = list(set().union(*groups))
        ids, offsets = self.vocabulary.merge([b"" if w in added else w.encode("utf-8", "replace") for w in distinct])
        special = [(i, added[w]) for i, w in enumerate(distinct) if w in added]
        if special:
            at, value = np.array(special, np.int64).T
            ids = np.insert(ids, offsets[at], value)
            offsets = offsets + np.searchsorted(at, np.arange(len(offsets)))
        place = {w: i for i, w in enumerate(distinct)}
        sizes = np.array([len(g) for g in groups], np.int64)
        at = np.fromiter((place[w] for g in groups for w in g), np.int64, sizes.sum())
        lengths = offsets[at + 1] - offsets[at]
        ends = np.append(0, np.cumsum(lengths))
        return ragged(ids.astype(np.int32), offsets[at], lengths), ends[np.append(0, np.cumsum(sizes))]

    def learn(self, units: list[str]) -> None:
        ids, offsets = self.direct([self.find(" " + u) for u in units])
        base = len(self.known)
        self.known.update((u, base + i) for i, u in enumerate(units))
        self.offsets = np.concatenate([self.offsets, len(self.ids) + offsets[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the offsets of the texts in it."""
        if len(self.known) > CACHE_UNITS or len(self.ids) > 8 * CACHE_UNITS:
            self.known, self.ids, self.offsets = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        added = self.vocabulary.added
        units: list[str] = []
        ends, firsts, odd = [0], [], set()
        for i, t in enumerate(texts):
            first, *rest = t.split(" ")
            if rest and (first == "" or first[-1].isspace()) or any(s in t for s in added):
                odd.add(i)
                rest = []
            units += rest
            firsts.append(first)
            ends.append(len(units))
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missed = np.flatnonzero(at < 0)
        fresh = {units[i] for i in missed}
        bad = {u for u in fresh if u == "" or u[0].isspace() or u[-1].isspace()}
        if bad:
            where = [i for i in missed if units[i] in bad]
            odd.update((np.searchsorted(ends, where, side="right") - 1).tolist())
        if fresh := list(fresh - bad):
            self.learn(fresh)
            at[missed] = [self.known.get(units[i], -1) for i in missed]
        own, own_offsets = self.direct([self.words(t if i in odd else f) for i, (t, f) in enumerate(zip(texts, firsts))])
        # One table of pieces: the known units, then the words that each text starts with (or consists of).
        flat = np.concatenate([self.ids, own])
        starts = np.concatenate([self.offsets[:-1], len(self.ids) + own_offsets[:-1]])
        lengths = np.concatenate([np.diff(self.offsets), np.diff(own_offsets)])
        ends = np.array(ends, np.int64)
        if odd:
            regular = np.ones(len(texts), bool)
            regular[list(odd)] = False
            keep = np.repeat(regular, np.diff(ends))
            ends = np.append(0, np.cumsum(np.where(regular, np.diff(ends), 0)))
            at = at[keep]
        at = np.insert(at, ends[:-1], len(self.known) + np.arange(len(texts)))
        ends = ends + np.arange(len(texts) + 1)
        own_lengths = lengths[at]
        offsets = np.append(0, np.cumsum(own_lengths))
        return ragged(flat, starts[at], own_lengths), offsets[ends]


def _broadcast(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))


def encode(df: DataFrame, path: str, text: Column | None = None, keep: Column | None = None) -> DataFrame:
    """``row`` and ``ids`` (array of int) of every text; a null text has no ids."""
    vocabulary = _broadcast(df, path)

    def run(batch, state=[]):  # noqa: B006  one encoder a worker
        if not state:
            state.append(Encoder(Vocabulary.of(vocabulary.value)))
        texts = [t or "" for t in batch["text"]]
        out = []
        for a, b in runs_of(texts):
            ids, offsets = state[0].encode(texts[a:b])
            out += [ids[x:y] for x, y in zip(offsets, offsets[1:])]
        return {"ids": out}

    return map_rows(df, run, {"text": F.col("text") if text is None else text}, "ids array<int>", keep)


def decode(df: DataFrame, path: str, ids: Column | None = None, keep: Column | None = None) -> DataFrame:
    """``row`` and ``decoded`` (string) of every array of ids; null is empty. Bytes that are no UTF-8 become U+FFFD."""
    vocabulary = _broadcast(df, path)

    def run(batch):
        ids = [x or [] for x in batch["ids"]]
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter((i for x in ids for i in x), np.int64, offsets[-1])
        return {"decoded": [x.decode("utf-8", "replace") for x in Vocabulary.of(vocabulary.value).decode(flat, offsets)]}

    return map_rows(df, run, {"ids": F.col("ids") if ids is None else ids}, "decoded string", keep)


def digests(df: DataFrame, path: str, text: Column | None = None, keep: Column | None = None) -> DataFrame:
    """``row``, ``n_tokens``, and the SHA-256 of the ids and of the decoded text, without moving the ids themselves.

    Ids are hashed as decimals joined by commas. Encoding and decoding run one after the other over a slice of texts.
    """
    from hashlib import sha256

    vocabulary = _broadcast(df, path)

    def run(batch, state=[]):  # noqa: B006  one encoder and the decimals of each id a worker
        if not state:
            shared = Vocabulary.of(vocabulary.value)
            decimal = [b"%d," % i for i in range(shared.size)]
            lengths = np.array([len(d) for d in decimal], np.int64)
            state.extend([Encoder(shared), np.frombuffer(b"".join(decimal), np.uint8), np.cumsum(lengths) - lengths, lengths])
        encoder, *decimals = state
        texts = [t or "" for t in batch["text"]]
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for a, b in runs_of(texts):
            ids, offsets = encoder.encode(texts[a:b])
            out["n_tokens"] += np.diff(offsets).tolist()
            out["ids_sha256"] += [sha256(x[:-1]).hexdigest() for x in pieces(*decimals, ids, offsets)]
            for x in encoder.vocabulary.decode(ids, offsets):
                out["decoded_sha256"].append(sha256(x.decode("utf-8", "replace").encode()).hexdigest())
        return out

    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(df, run, {"text": F.col("text") if text is None else text}, kinds, keep)
