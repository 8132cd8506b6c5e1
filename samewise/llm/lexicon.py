"""Minimal acyclic transducer of frequent words with their token ids, and an exact byte-level BPE encoder on top of it.

A word here is what stands between two places at which the split pattern always cuts: before each space that a character
other than white space follows. The automaton shares prefixes and suffixes (Daciuk's construction over sorted words); the
numbers on its arcs add up to a word's ordinal, which finds the word's ids. It is written once to a file that Spark hands to
every executor, and memory-mapped there. Words that it does not hold are split by the pattern and merged exactly."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm import byte_bpe
from samewise.llm.common import bounded_batches, cut, put_shared

#: Characters of the texts that are encoded together.
TOGETHER = 2_000_000
PARTS = ("first_arc", "final", "key", "target", "skip", "at", "ids")


def build(words: list[bytes], outputs: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton over sorted distinct words; outputs[i] are the ids of words[i]."""
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []  # by state: final, ((label, target), ...)

    def freeze(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the states of the last word that may still change: [final, arcs]; the last arc's target is open
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1][-1] = (path[-1][1][-1][0], freeze(final, arcs))

    for w in words:
        if path[0][1] and w <= last:
            raise ValueError("words must be sorted and distinct")
        same = len(os.path.commonprefix([w, last]))
        close(same)
        for b in w[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(*path[0])
    n = len(frozen)
    below = [0] * n  # words that end at or after a state; targets are frozen before their sources
    first, keys, targets, skips = np.zeros(n + 1, np.int64), [], [], []
    for s, (final, arcs) in enumerate(frozen):
        k = int(final)
        for label, target in arcs:
            keys.append(s * 256 + label)
            targets.append(target)
            skips.append(k)
            k += below[target]
        below[s] = k
        first[s + 1] = len(keys)
    at = np.zeros(len(words) + 1, np.int64)
    at[1:] = np.cumsum([len(x) for x in outputs])
    return {
        "first_arc": np.array([root], np.int64), "final": np.array([f for f, _ in frozen], np.uint8), "key": np.array(keys, np.int64),
        "target": np.array(targets, np.int64), "skip": np.array(skips, np.int64), "at": at, "ids": np.array([i for x in outputs for i in x], "<u4")
    }


def saved(parts: dict[str, np.ndarray]) -> bytes:
    """A head of seven (count) numbers, then the arrays, each padded to eight bytes."""
    raw = [np.array([len(parts[p]) for p in PARTS], "<i8").tobytes(), *(parts[p].tobytes() for p in PARTS)]
    return b"".join(r + b"\0" * (-len(r) % 8) for r in raw)


class Automaton:
    """A memory-mapped file of saved()."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        sizes, at = raw[:56].view("<i8"), 56
        for name, n in zip(PARTS, sizes):
            kind = np.dtype({"final": "u1", "ids": "<u4"}.get(name, "<i8"))
            n = int(n) * kind.itemsize
            setattr(self, name, raw[at : at + n].view(kind))
            at += n + -n % 8
        self.root = int(self.first_arc[0])

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the sorted words, -1 for others; all words take a step at a time."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        size = np.array([len(w) for w in words], np.int64)
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        alive, state, total, depth = np.arange(n), np.full(n, self.root, np.int64), np.zeros(n, np.int64), 0
        while len(alive):
            ended = size[alive] == depth
            hit = ended & (self.final[state] == 1)
            out[alive[hit]] = total[hit]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            if not len(alive):
                break
            key = state * 256 + flat[start[alive] + depth]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            alive, total, state = alive[ok], total[ok] + self.skip[arc[ok]], self.target[arc[ok]]
            depth += 1
        return out

    def output(self, ordinal: int) -> bytes:
        return self.ids[self.at[ordinal] : self.at[ordinal + 1]].tobytes()


SPACED = regex.compile(r" (?=\P{White_Space})")
#: A space that doesn't simply set off a word; Python's white space holds all that the pattern's does, and a little more.
ODD = re.compile(r" (?:\s|\Z)")


def words_of(text: str) -> list[str]:
    """The words of a text, each but the first with the space before it left out."""
    return SPACED.split(text) if ODD.search(text) else text.split(" ")


class Encoder:
    """Exact ids of texts: memo of this worker, then the automaton, then merges. `most`: words that the memo holds at once."""

    def __init__(self, bpe: byte_bpe.ByteBpe, automaton: Automaton | None, most: int = 600_000):
        self.bpe, self.automaton, self.most, self.memo = bpe, automaton, most, {}
        names = sorted(bpe.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of words that the automaton doesn't hold: split by the pattern, all their parts merged by least rank together."""
        # letters alone, but for a space before them, are one part of the pattern
        several = {w: self.bpe.words.findall(w) for w in words if not (w[1:].isalpha() if w[:1] == " " else w.isalpha())}
        parts = list({w for w in words if w not in several}.union(*several.values()))
        merged = dict(zip(parts, self.bpe.merge_all([p.encode() for p in parts])))
        return [b"".join([merged[p] for p in several[w]]) if w in several else merged[w] for w in words]

    def learn(self, words: list[str]) -> None:
        """words: without the space that stands before each, not in the memo."""
        spaced = [" " + w for w in words]
        found = self.automaton.ordinals([w.encode() for w in spaced]).tolist() if self.automaton else [-1] * len(words)
        unseen = [i for i, k in enumerate(found) if k < 0]
        self.memo.update(zip([words[i] for i in unseen], self.merge([spaced[i] for i in unseen])))
        self.memo.update((w, self.automaton.output(k)) for w, k in zip(words, found) if k >= 0)

    def _first(self, word: str) -> bytes:
        """The ids of a text's first word, which no space stands before."""
        return b"".join(np.array(self.bpe.merge(p.encode()), "<u4").tobytes() for p in self.bpe.words.findall(word))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens. What their words lack in the memo is learned together."""
        split = [words_of(t) for t in texts]
        heads = [x.pop(0) for x in split]
        new = set().union(*split).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.most:
                self.memo.clear()
                new = set().union(*split)
            self.learn(list(new))
        return [b"".join([self._first(h), *map(self.memo.__getitem__, x)]) for h, x in zip(heads, split)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; strings of special tokens become those tokens.

        Texts are taken together up to about `TOGETHER` characters, so that the memo needs room for the words of these alone."""
        held: list[str] = []
        size = 0
        for t in texts:
            if self.special is not None and any(s in t for s in self.bpe.specials):
                yield from self._plain(held)
                held, size = [], 0
                parts = self.special.split(t)
                plain = iter(self._plain([p for p in parts if p not in self.bpe.specials]))
                yield b"".join(np.array([self.bpe.specials[p]], "<u4").tobytes() if p in self.bpe.specials else next(plain) for p in parts)
                continue
            held.append(t)
            size += len(t)
            if size > TOGETHER:
                yield from self._plain(held)
                held, size = [], 0
        yield from self._plain(held)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        tokens = self.bpe.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, size: int, most: int = 200_000) -> DataFrame:
    """The most frequent words of all texts, `size` at most and all of equal count or none. Counts are summed in each task first, `most` words at a time."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                parts = words_of(t.as_py())
                held.update(parts[1:])
                if len(held) > most:
                    yield out()
                    held.clear()
        yield out()

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null and text != ''")
    counts = cut(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    # the least count that still leaves room for all words of it: a row for each count, and no task sends its own best words
    held, least = 0, 2
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect():
        if held + r["words"] > size:
            least = r["n"] + 1
            break
        held += r["words"]
    return counts.where(F.col("n") >= least)


_sent: set[tuple[str, str]] = set()


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int) -> str:
    """Compiles the frequent words of docs; returns the file's name for SparkFiles."""
    bpe = byte_bpe.load(tokenizer)
    enc = Encoder(bpe, None)
    words = sorted({(" " + r["word"]).encode() for r in frequent_words(docs, size).collect()})  # `size` rows at most
    parts = build(words, [np.frombuffer(ids, "<u4").tolist() for ids in enc.merge([w.decode() for w in words])])
    packed = saved(parts)
    name = f"lexicon-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    sc = docs.sparkSession.sparkContext
    if (sc.applicationId, name) not in _sent:  # a file of this name has these contents
        sc.addFile(put_shared(docs.sparkSession, name, packed))
        _sent.add((sc.applicationId, name))
    return name


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """This worker's encoder, one at a time."""
    key = (tokenizer, lexicon or "")
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(byte_bpe.load(tokenizer), Automaton(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer: str, size: int = 32_768) -> DataFrame:
    """doc_id, ids (array of int), decoded text: every whole text encoded, then decoded again.

    A null text counts as empty and has no ids; a null doc_id stays; repeated rows give repeated rows; extra columns
    are ignored; an empty table compiles an empty lexicon and gives no rows."""
    return _encoded(docs, tokenizer, compile_lexicon(docs, tokenizer, size), digests=False)


def digests(docs: DataFrame, tokenizer: str, size: int = 32_768) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with its results as digests, so that no ids move."""
    return _encoded(docs, tokenizer, compile_lexicon(docs, tokenizer, size), digests=True)


def _encoded(docs: DataFrame, tokenizer: str, lexicon: str, digests: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer, lexicon)
        for b in batches:
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for ids in enc.encode_all(texts):
                text = enc.decode(ids)
                out.append((
                    len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                ) if digests else (np.frombuffer(ids, "<u4").astype(np.int32), text))
            kinds = ((pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string()))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", *(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
