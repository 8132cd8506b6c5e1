"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Tokens are counted once per document; only small rows (place, length, checksum) move. The instance is the number of
pieces of each length, at most `capacity` numbers, so it is solved whole on the driver; pieces find their sequence by
their rank among the pieces of their length. Nulls and empty texts hold the end token alone; a null doc_id stays null;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from samewise.llm import byte_bpe
from samewise.llm.common import bounded_batches, cut

_loaded: dict = {}


def encoder(path: str):
    """A function from text to the array of its ids, special tokens' strings included, as the tokenizers library gives them."""
    if path not in _loaded:
        bpe = byte_bpe.load(path)
        fast = byte_bpe.as_tiktoken(bpe)
        names = set(bpe.specials)

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special=names)
            except ValueError:  # the library's pattern gives up on very long runs of white space
                return np.array(exact_ids(bpe, text), "<u4")

        _loaded[path] = encode
    return _loaded[path]


def exact_ids(bpe: byte_bpe.ByteBpe, text: str) -> list[int]:
    import regex

    parts = regex.split("(" + "|".join(map(regex.escape, sorted(bpe.specials, key=len, reverse=True))) + ")", text) if bpe.specials else [text]
    out: list[int] = []
    for part in parts:
        if part in bpe.specials:
            out.append(bpe.specials[part])
        else:
            for w in bpe.words.findall(part):
                out += bpe.merge(w.encode())
    return out


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity if n > capacity else n
    first = first or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("nth", T.LongType())
])


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece; part and nth: the task that made it, and its place among that task's pieces of its length."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    out.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=PIECES.names
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Plan:
    """Groups of equal sequences: how many, and the lengths in each with their number of copies."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, []

    def add(self, times: int, lengths: tuple[int, ...]) -> None:
        if times:
            self.groups.append((times, lengths))

    def sequences(self) -> int:
        return sum(t for t, _ in self.groups)


def _smallest(left: list[int], n: int, above: int = 0) -> list[int]:
    """The n smallest lengths that are left over `above`, each as often as it is left; fewer if there are no more."""
    out: list[int] = []
    for b in range(above + 1, len(left)):
        out += [b] * min(left[b], n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(left: list[int], room: int) -> tuple[int, int] | None:
    """The two lengths left with the greatest sum within the room, the longest of them as long as can be."""
    best, low = None, 1
    for high in range(min(room, len(left) - 1), 0, -1):
        if not left[high]:
            continue
        low = min(high, room - high)
        while low > 0 and not left[low] - (low == high) > 0:
            low -= 1
        if low > 0 and (best is None or high + low > sum(best)):
            best = (high, low)
        if best is not None and 2 * high <= sum(best):
            break
    return best


def reduce_by_dominance(left: list[int], capacity: int, plan: Plan) -> dict[str, int]:
    """Fixes sequences that dominate every other one holding their largest piece; left: number by length, changed here.

    A full piece stands alone. A pair that fills a sequence dominates all that hold either of the two, since whatever
    takes one's place fits into the other's. A piece with which nothing else fits stands alone; one with which at most
    one other fits takes the largest that fits. If at most two fit, the largest that fits dominates if it is no shorter than the best pair;
    else the best pair does if it holds that largest and no two pieces longer than its shorter one fit together.
    From the largest piece on, until three others fit."""
    fixed = {"alone": 0, "exact_pairs": 0, "best_pairs": 0, "triples": 0}
    plan.add(left[capacity], (capacity,))
    fixed["alone"] += left[capacity]
    left[capacity] = 0
    for a in range(capacity - 1, capacity // 2 - 1, -1):
        b = capacity - a
        if 0 < b <= a and (k := left[a] // 2 if a == b else min(left[a], left[b])):
            plan.add(k, (a, b))
            left[a] -= k
            left[b] -= k
            fixed["exact_pairs"] += k

    def fix(lengths: tuple[int, ...], rule: str, spare: int) -> None:
        """Takes the sequence as often as its pieces are left, but for `spare` times that may change what the rule saw; once at least."""
        need = Counter(lengths)
        k = max(1, min(left[x] // n for x, n in need.items()) - spare)
        plan.add(k, lengths)
        fixed[rule] += k
        for x, n in need.items():
            left[x] -= k * n

    for a in range(capacity - 1, 0, -1):
        while left[a]:
            room = capacity - a
            left[a] -= 1
            small = _smallest(left, 3)
            fits = sum(1 for k in range(len(small)) if sum(small[: k + 1]) <= room)
            best = next((b for b in range(min(room, capacity), 0, -1) if left[b]), 0)
            pair = _best_pair(left, room) if fits == 2 else None
            over = _smallest(left, 2, pair[1]) if pair else []
            left[a] += 1
            if fits > 2:
                return fixed  # three others can share a sequence with it, and with every smaller one
            if not fits:
                fix((a,), "alone", 0)
            elif fits == 1 or best >= sum(pair):
                fix((a, best), "best_pairs", 0 if fits == 1 else 3)
            elif best == pair[0] and (len(over) < 2 or sum(over) > room):
                fix((a, *pair), "triples", 3)
            else:
                break  # no rule for this length; a shorter one may have one
    return fixed


def best_fit(left: list[int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing over counts: each piece goes to the fullest sequence with room, equal ones together."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if room not in by_room:
                insort(rooms, room)
            by_room[room][lengths] += times

    for a in range(capacity, 0, -1):
        n = left[a]
        while n:
            at = bisect_left(rooms, a)
            if at == len(rooms):
                each = capacity // a
                put(capacity - each * a, (a,) * each, n // each)
                if rest := n % each:
                    put(capacity - rest * a, (a,) * rest, 1)
                break
            room = rooms[at]
            lengths, times = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = room // a
            full = min(times, n // each)
            put(room - each * a, lengths + (a,) * each, full)
            n, times = n - full * each, times - full
            if times and 0 < n < each:
                put(room - n * a, lengths + (a,) * n, 1)
                n, times = 0, times - 1
            put(room, lengths, times)
        left[a] = 0
    for groups in by_room.values():
        for lengths, times in groups.items():
            plan.add(times, lengths)


def solve(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[str, int]]:
    left, plan = [0] * (capacity + 1), Plan(capacity)
    for length, n in counts.items():
        left[length] += n
    fixed = reduce_by_dominance(left, capacity, plan)
    best_fit(left, capacity, plan)
    return plan, fixed


def places(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows of first rank, copies in a sequence, first sequence, offset in it. Ranks of a length are used in order."""
    out, used, first = defaultdict(list), Counter(), 0
    for times, lengths in plan.groups:
        at = 0
        for length, copies in sorted(Counter(lengths).items(), reverse=True):
            out[length].append((used[length], copies, first, at))
            used[length] += times * copies
            at += length * copies
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    bounded_batches(docs.sparkSession)
    made = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = solve(counts, capacity)
    where = made.sparkSession.sparkContext.broadcast(places(plan))  # bounded by the capacity: best-fit makes few kinds of sequences for each length
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = made.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"])

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, t = np.flatnonzero(length == n), where.value[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                seq[own], off[own] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PACKED.names[:5]), pa.array(seq), pa.array(off)], names=PACKED.names)

    return ranked.select(*PACKED.names[:5], (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, PACKED)
