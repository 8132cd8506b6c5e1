"""Byte-level BPE vocabularies: read a tokenizers JSON file, split texts into words, merge words exactly."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import regex

#: The byte-level split pattern, with Unicode's White_Space spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


NONE = (1 << 40, 0)
NEVER = (1 << 31) - 1
LONG = 48  # bytes of a word that many are merged beside


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32 and not 127 <= b <= 160 and b != 173]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTable:
    """Ranks by pairs of ids in an open hash table, so that many pairs are looked up at once; merged: the new id by rank."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        items = np.array([(*p, *m) for p, m in pairs.items()], np.int64).reshape(-1, 4)
        self.merged = np.zeros(int(items[:, 2].max(initial=-1)) + 1, np.int32)
        self.merged[items[:, 2]] = items[:, 3]
        self.shift = 64 - max(4, int(len(items) * 4).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.held = np.full(len(self.keys), NEVER, np.int32)
        want, rank = items[:, 0] << 32 | items[:, 1], items[:, 2]
        at, self.reach = self._place(want), 0
        while len(want):
            free = self.keys[at] < 0
            slot, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slot >= 0]
            self.keys[at[first]], self.held[at[first]] = want[first], rank[first]
            left = np.ones(len(want), bool)
            left[first] = False
            want, rank, at = want[left], rank[left], (at[left] + 1) & (len(self.keys) - 1)
            self.reach += 1

    def _place(self, want: np.ndarray) -> np.ndarray:
        return (want.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for what doesn't merge; a negative id merges with nothing."""
        want = left.astype(np.int64) << 32 | right
        at = self._place(want)
        found = self.keys[at]
        out = np.where(found == want, self.held[at], NEVER)
        # what met another pair may stand behind it
        open_ = np.flatnonzero(((found != want) & (found >= 0)).ravel())
        flat, want, at = out.reshape(-1), want.ravel()[open_], at.ravel()[open_]
        for _ in range(self.reach):
            if not len(open_):
                break
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == want
            flat[open_[hit]] = self.held[at[hit]]
            more = ~hit & (found >= 0)
            open_, want, at = open_[more], want[more], at[more]
        return flat.reshape(out.shape)


@dataclass
class ByteBpe:
    """tokens: bytes by id. specials: text to id. pairs: (left id, right id) to (rank, merged id)."""

    tokens: list[bytes]
    specials: dict[str, int]
    pairs: dict[tuple[int, int], tuple[int, int]]
    of_byte: list[int] = field(default_factory=list)
    table: PairTable | None = None

    def __post_init__(self):
        by = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.of_byte = [by[bytes([b])] for b in range(256)]
        self.words = regex.compile(SPLIT)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: always the pair of least rank, leftmost first."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, none = self.pairs.get, NONE
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER for what doesn't merge."""
        if self.table is None:
            self.table = PairTable(self.pairs)
        return self.table.ranks(left, right)

    def merge_all(self, words: list[bytes], together: int = 8_192) -> list[bytes]:
        """merge() of many words at once, as little-endian unsigned 32-bit ids: each step merges the pair of least rank, leftmost first, of all words that still have one.

        Words of like length are taken together; those of more than LONG bytes each on their own."""
        out: list = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for i in order[size[order] > LONG].tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        order = order[(size[order] <= LONG) & (size[order] > 0)]
        of_byte = np.array(self.of_byte, np.int32)
        for at in range(0, len(order), together):
            some = order[at : at + together]
            ids = np.full((len(some), int(size[some[-1]]) + 1), -1, np.int32)
            ids[np.arange(ids.shape[1])[None] < size[some][:, None]] = of_byte[np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)]
            merged, n = self._merged(ids)
            raw, width = merged.tobytes(), merged.shape[1] * 4
            for i, start, end in zip(some.tolist(), range(0, len(raw), width), (np.arange(len(some)) * width + n * 4).tolist()):
                out[i] = raw[start:end]
        return out

    def _merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids after all merges, a row for each word, and how many of a row are a word's; -1 stands behind the end."""
        out, sizes = np.zeros(ids.shape, "<u4"), np.zeros(len(ids), np.int64)
        rows, ranks = np.arange(len(ids)), self._ranks(ids[:, :-1], ids[:, 1:])
        by_rank = self.table.merged
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), NEVER)
            done = best == NEVER
            if done.any():
                out[rows[done], : ids.shape[1]] = np.where(ids[done] < 0, 0, ids[done])
                sizes[rows[done]] = (ids[done] >= 0).sum(1)
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
            if not len(rows):
                return out, sizes
            every, place = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            # what stands behind a merged pair moves one place to the left
            ids = np.take_along_axis(ids, place[None] + (place[None] > at[:, None]), 1)
            ids[every, at] = by_rank[best]
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place[None] + (place[None] > at[:, None]), 1)
            if not ranks.shape[1]:
                continue
            before, behind = at > 0, at < ranks.shape[1]
            r, a = every[before], at[before]
            ranks[r, a - 1] = self._ranks(ids[r, a - 1], ids[r, a])
            r, a = every[behind], at[behind]
            ranks[r, a] = self._ranks(ids[r, a], ids[r, a + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n, with a heap of pairs over a linked list."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := pairs.get((merged, ids[after[i]])):
                    heapq.heappush(heap, (*p, i, merged, ids[after[i]]))
            if (k := before[i]) >= 0 and (p := pairs.get((ids[k], merged))):
                heapq.heappush(heap, (*p, k, ids[k], merged))
        return [x for x in ids if x >= 0]


def load(path: str) -> ByteBpe:
    """Reads a tokenizers JSON file; ValueError if it is no plain byte-level BPE, whose merges this module can do."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get(
        "use_regex", True
    ) or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    byte = printable_bytes()
    vocab = model["vocab"]
    specials = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for t, i in vocab.items():
        tokens[i] = t.encode() if t in specials else bytes(byte[c] for c in t)
    for t, i in specials.items():
        tokens[i] = t.encode()
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(model["merges"]):
        left, right = m.split(" ") if isinstance(m, str) else m
        pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    return ByteBpe(tokens, specials, pairs)


def as_tiktoken(bpe: ByteBpe):
    """The same vocabulary in the tiktoken library, which merges by the id of the merged token; ValueError unless ids rise with the merges' ranks."""
    import tiktoken

    merged = [i for _, i in sorted(bpe.pairs.values())]
    if merged != sorted(merged):
        raise ValueError("ids don't rise with ranks")
    special = set(bpe.specials.values())
    return tiktoken.Encoding(
        "own", pat_str=SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"),
        mergeable_ranks={t: i for i, t in enumerate(bpe.tokens) if i not in special}, special_tokens=bpe.specials
    )
