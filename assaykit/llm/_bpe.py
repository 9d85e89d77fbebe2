"""Byte-pair encoding in batched numpy rounds.

Classes of characters are asked of the tokenizers library, and texts with characters that are not in Unicode 3.2 are composed
and lower-cased by it, so that ids equal the library's for every code point on every executor.

Texts are cut into pre-tokens on one flat array of code points. Equal pre-tokens are found by a 64-bit rolling hash and
encoded once. All symbols of the pre-tokens to encode lie in one flat array: a round finds every word's lowest-rank pair
(ranks come from a binary search over the sorted pair keys), merges it wherever it occurs in that word, and looks up only
the pairs that the merges changed. Words without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

from assaykit.llm._text import code_points

NONE = np.int32(2**31 - 1)
#: Unicode White_Space, and the endings that the tokenizer files split from a word after an apostrophe.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Pre-tokens beyond this length get a cryptographic hash.
LONG = 256
ODD = np.uint64(0x9E3779B97F4A7C15)
POWER, INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


#: Planes of Unicode that hold characters; the others are unassigned or private.
PLANES = (0, 1, 2, 3, 14)


def matching(pattern: str) -> np.ndarray:
    """Which code points the tokenizers library counts in a class of its regular expressions, whatever Unicode this Python knows."""
    split, out = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed"), np.zeros(0x110000, bool)
    for plane in PLANES:
        points = np.arange(plane << 16, (plane + 1) << 16)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        inside = np.ones(len(points), bool)
        for _, (a, z) in split.pre_tokenize_str("".join(map(chr, points.tolist()))):
            inside[a:z] = False
        out[points[inside]] = True
    return out


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    out[matching(r"\p{L}")] = LETTER
    out[matching(r"\p{N}")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(maxsize=1)
def recent() -> np.ndarray:
    """Code points assigned after Unicode 3.2: of these, this Python and the library may know different ones."""
    out = np.zeros(0x110000, bool)
    for plane in PLANES:
        for i in range(plane << 16, (plane + 1) << 16):
            out[i] = unicodedata.ucd_3_2_0.category(chr(i)) == "Cn"
    return out


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; n is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Vocabulary:
    """Merge table, symbols and text rules of one BPE tokenizer file (byte-level, or lower-case with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        chars = byte_characters()
        self.first = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in chars], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and the number of ids of each."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(lens)[lens > 0] - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        if (sym < 0).any():  # a vocabulary without that byte: such symbols yield nothing
            sym, word = sym[sym >= 0], word[sym >= 0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.ranks(sym[same], sym[same + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            if (best == NONE).any():
                over = np.repeat(best == NONE, sizes)
                done.append((word[over], sym[over]))
                left = ~over
                sym, word, rank = sym[left], word[left], rank[left]
                best, sizes = best[best != NONE], sizes[best != NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, sizes)
            before = np.concatenate(([False], hit[:-1]))
            if (hit & before).any():  # a run of one repeated symbol: every other pair of the run, from its start
                at = np.arange(len(hit))
                hit &= (at - np.maximum.accumulate(np.where(hit & ~before, at, -1))) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            now = where - np.arange(len(where))  # each earlier merge has taken one symbol away
            sym, word, rank = sym[keep], word[keep], rank[keep]
            rank[now] = NONE
            right = now[now < len(sym) - 1]
            right = right[word[right] == word[right + 1]]
            rank[right] = self.ranks(sym[right], sym[right + 1])
            left = now[now > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self.ranks(sym[left], sym[left + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(pieces)).astype(np.int64)

    def normal(self, text: str) -> str:
        """The word tokenizer's normal form: composed, lower case (each character by itself); else the text itself."""
        if not self.words:
            return text
        if not text.isascii():
            if recent()[code_points([text])[0]].any():
                return self.library.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at what surrounds a capital sigma
                return "σ".join(x.lower() for x in text.split("Σ"))
        return text.lower()

    def starts(self, cp: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, and which of them count, for texts that begin at ``begins`` in ``cp``."""
        kind = kinds()[cp]
        space = kind == SPACE
        first = np.zeros(len(cp), bool)
        first[begins] = True
        last = np.append(first[1:], True)
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        if self.words:
            start = change | (kind == NUMBER)
        else:
            joined = np.zeros(len(cp), bool)  # after one blank of the same text
            joined[1:] = (cp[:-1] == 32) & ~first[1:]
            tail = np.append(space[:-1] & ~space[1:], False) & ~last  # the last of a run of white space before other text
            start = np.where(space, change | tail, change & ~joined)
        mark = np.flatnonzero((cp == 39) & start & ~last)
        if len(mark):  # 's, 't and the like, where the apostrophe starts a pre-token
            one = np.isin(cp[mark + 1], [ord(c) for c in ENDINGS_1])
            two = np.zeros(len(mark), bool)
            room = np.flatnonzero((mark + 2 < len(cp)) & ~last[mark + 1])
            for a, b in ENDINGS_2:
                two[room] |= (cp[mark[room] + 1] == ord(a)) & (cp[mark[room] + 2] == ord(b))
            start[mark[one | two] + 1] = False
            start[mark[two] + 2] = False
            after = np.concatenate((mark[one] + 2, mark[two] + 3))
            after = after[after < len(cp)]
            start[after] = True
        at = np.flatnonzero(start)
        return at, (~space[at] if self.words else np.ones(len(at), bool))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts, each distinct pre-token once; keeps about ``limit`` of them between batches.

    Without ``specials`` the strings of special tokens are text like any other.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 200_000, specials: bool = True):
        self.vocab, self.limit, self.specials = vocab, limit, specials
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Takes in new pre-tokens, in the order of their rows."""
        ids, counts = self.vocab.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        self.ids = np.concatenate((self.ids, ids))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))

    def rows_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """The row of each pre-token of all texts, the number of pre-tokens of each text, and rows of special tokens."""
        if len(self.hashes) > self.limit:
            self.clear()
        v = self.vocab
        parts: list[str] = []
        owner: list[int] = []
        special: dict[int, int] = {}  # by part
        for n, t in enumerate(texts):
            if not t:
                continue
            if self.specials and "<|" in t and v.special:
                for k, p in enumerate(v.specials.split(t)):
                    if p:
                        if k % 2:
                            special[len(parts)] = v.special[p]
                        parts.append(p if k % 2 else v.normal(p))
                        owner.append(n)
            else:
                parts.append(v.normal(t))
                owner.append(n)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), {}
        whole = "".join(parts)
        cp, lens = code_points(parts)
        begins = np.concatenate(([0], np.cumsum(lens)[:-1]))
        at, real = v.starts(cp, begins)
        part = np.searchsorted(begins, at, side="right") - 1
        ends = np.append(at[1:], len(cp))
        hashes = self.hash(cp, at, ends, whole)
        if special:
            for p, i in special.items():  # one pre-token, under a hash of its own
                where = np.flatnonzero(part == p)
                real[where] = False
                real[where[0]] = True
                hashes[where[0]] = np.uint64(i + 1)
        at, ends, part, hashes = at[real], ends[real], part[real], hashes[real]
        unique, index, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        rows = np.zeros(len(unique), np.int64)
        if known.any():
            rows[known] = self.rows[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            rows[fresh] = np.arange(len(fresh)) + len(self.hashes)
            at_new = index[fresh]
            fixed = {n: special[int(part[k])] for n, k in enumerate(at_new.tolist()) if int(part[k]) in special} if special else {}
            self.learn([whole[a:b] for a, b in zip(at[at_new].tolist(), ends[at_new].tolist(), strict=True)])
            base = len(self.hashes)
            for n, i in fixed.items():
                self.set_row(base + n, i)
            merged = np.concatenate((self.hashes, unique[fresh]))
            order = np.argsort(merged, kind="stable")
            self.rows = np.concatenate((self.rows, rows[fresh]))[order]
            self.hashes = merged[order]
        counts = np.bincount(np.array(owner)[part], minlength=len(texts)) if len(part) else np.zeros(len(texts), np.int64)
        return rows[which], counts, special

    def set_row(self, row: int, token: int) -> None:
        """Makes a row stand for one special token."""
        a, b = self.offsets[row], self.offsets[row + 1]
        self.ids = np.concatenate((self.ids[:a], [np.int32(token)], self.ids[b:])).astype(np.int32)
        self.offsets = np.concatenate((self.offsets[: row + 1], self.offsets[row + 1 :] + (1 - (b - a))))

    @staticmethod
    def hash(cp: np.ndarray, at: np.ndarray, ends: np.ndarray, whole: str) -> np.ndarray:
        n = 1 << max(10, int(len(cp)).bit_length())
        z = cp.astype(np.uint64) * ODD
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(z * powers(POWER, n)[: len(cp)], dtype=np.uint64)))
        out = (total[ends] - total[at]) * powers(INVERSE, n)[at] + (ends - at).astype(np.uint64) * ODD
        for k in np.flatnonzero(ends - at > LONG):
            out[k] = np.uint64(int.from_bytes(hashlib.blake2b(whole[at[k] : ends[k]].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each; null counts as empty."""
        rows, counts, _ = self.rows_of(texts)
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        total = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return take_runs(self.ids, self.offsets, rows), np.diff(total)


def take_runs(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs values[offsets[i]:offsets[i + 1]] for i in which, one after the other."""
    sizes = offsets[which + 1] - offsets[which]
    total = int(sizes.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(sizes)
    return values[np.arange(total) - np.repeat(ends - sizes - offsets[which], sizes)]
