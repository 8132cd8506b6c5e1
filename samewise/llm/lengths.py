"""Token counts of whole texts by a public tokenizer's own library, lengths alone leaving the tasks.

Texts are dealt into batches of about equal bytes. Every text is split at places where the tokenizer always cuts, so that a long
text never meets the library whole, and the count of a piece that was met before is remembered. What is new to a batch is encoded by one call.

Where a cut is safe depends on the file:

- a .json file whose text is cut by the byte-level pattern, or which replaces white space and drops it: before a space that a character
  other than white space follows. The piece keeps its space.
- a .model file whose pieces hold white space at their beginning alone: at a single space between two other characters. The piece loses
  it, as the library puts one before every text.
- any other file: nowhere, each text is one piece."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, free_name
from samewise.llm.lexicon import words_of

#: The white space of a .model file's pieces.
BLANK = "▁"
#: The space before a word in a byte-level vocabulary file, and words that are encoded together.
SPACE, TOGETHER = "Ġ", 64
#: A single space between two characters that are no white space.
SINGLE = regex.compile(rf"(?<=[^\p{{White_Space}}{BLANK}]) (?=[^\p{{White_Space}}{BLANK}])")


def _json_cuts(path: str) -> str:
    """Whether a text of this .json tokenizer may be cut before a space that no white space follows: kept or dropped, as that space is, or nothing."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    if any(c.isspace() for t in made["added_tokens"] for c in t["content"]) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        return ""
    pre, norm = made["pre_tokenizer"] or {}, made["normalizer"]
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "kept"
    steps = {x["type"] for x in norm["normalizers"]} if norm and norm["type"] == "Sequence" else set()
    first = (pre.get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]  # what the pattern doesn't name goes
    return "dropped" if drops and "Replace" in steps and steps <= {"NFC", "Replace", "Lowercase"} else ""


class Counter:
    """Exact token counts. most: pieces that the memo holds at once."""

    def __init__(self, path: str, most: int = 600_000):
        self.most, self.memo, self.first = most, {}, {}
        self.lengths_of_words = lambda words: self.lengths([self.glue + w for w in words] if self.glue else words)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
            inside = any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size()))
            # a dummy blank stands before every text, and blanks are neither dropped nor joined
            plain = not inside and model.encode("a", out_type=str)[0].startswith(BLANK) and len("".join(model.encode("a  b", out_type=str))) == 5
            self.split, self.glue = (SINGLE.split if plain else lambda t: [t]), ""
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.ids = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.lengths = lambda texts: list(map(len, self.ids(texts)))
            self.split, self.glue = (words_of, " ") if (cuts := _json_cuts(path)) else (lambda t: [t], "")
            if cuts == "kept":
                self.opens = np.zeros(model.get_vocab_size() + 1, bool)
                self.opens[[i for w, i in model.get_vocab().items() if w.startswith(SPACE)]] = True
                self.lengths_of_words = self._together

    def _together(self, words: list[str]) -> list[int]:
        """The tokens of each word and the space before it, many words to a text: every word's first token opens with that space.

        Where a group of words has more such tokens, one of its words holds a space itself, and they are encoded one by one."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[int] = []
        for group, ids in zip(groups, self.ids([" " + " ".join(g) for g in groups])):
            first = np.flatnonzero(self.opens[ids])
            out += np.diff(first, append=len(ids)).tolist() if len(first) == len(group) else self.lengths([" " + w for w in group])
        return out

    def _learn(self, memo: dict, pieces: set, lengths: Callable[[list[str]], list[int]]) -> None:
        new = list(pieces.difference(memo))
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = list(pieces)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            memo.update(zip(part, lengths(part)))

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text; the texts' pieces are learned together."""
        split = [self.split(t) for t in texts]
        self._learn(self.first, {x[0] for x in split}, self.lengths)
        self._learn(self.memo, set().union(*(islice(x, 1, None) for x in split)), self.lengths_of_words)
        head, rest = self.first, self.memo.__getitem__
        return [head[x[0]] + sum(map(rest, islice(x, 1, None))) for x in split]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter, one at a time."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def balanced(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of the texts of about `size` bytes each: a text more is taken while less than that is held."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(len(texts), max(at + 1, int(ends.searchsorted(before + size, "left")) + 1))
        yield texts.slice(at, to - at)
        at = to


def _counted(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int) -> Iterator[pa.RecordBatch]:
    own = counter(tokenizer)
    for b in batches:
        texts = b.column(0)
        found = [n for part in balanced(texts, size) for n in own.count([t or "" for t in part.to_pylist()])]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(found, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"]
        )


def count(docs: DataFrame, tokenizer: str, limit: int = 512, size: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text; `size`: bytes of a batch.

    The tokenizer's file, .json or .model, is read by its library: no begin, end or other special token is added, special strings inside
    a text are what the library makes of them by default, nothing is truncated or padded. A null text counts as empty: no bytes, no
    tokens. A null doc_id stays; repeated rows give repeated rows; extra columns are ignored, whatever their names; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    text = free_name(docs.select("doc_id"), "text")
    rows = docs.select(F.col("text").cast("string").alias(text), F.col("doc_id").cast("long").alias("doc_id"))
    found = rows.mapInArrow(partial(_counted, tokenizer=tokenizer, size=size), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
