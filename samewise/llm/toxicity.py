"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine on sentences.

The kernel of two words counts their common subsequences of four characters within a span of six, each weighted by a decay for
every character of its span, so that inserted characters and gaps cost little; it is normalised and raised to a power. The
kernel of two sentences is the sum over their words. Landmarks are words that set toxic documents apart, and common clean
words. Labels are of documents, so each round takes the highest sentence of a toxic document as its witness; sentences of
clean documents are all clean. A document's score is a logistic of its highest sentences.

In the span of Nyström features a sentence's score is a sum over words, so each distinct word's share is computed once a worker.
Null and empty texts get the score of a sentence without words; whole texts of any length count; repeated rows give
repeated rows; null doc_ids stay; extra columns are ignored; without labels of both classes all scores are 0."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, crc_mod

LENGTH, SPAN, DECAY, POWER = 4, 6, 0.7, 3
#: Windows of a token's letters, see forms(): characters, and from one to the next.
WINDOWS = ((12, 2), (40, 10))
LONGEST = WINDOWS[-1][0]  # of a landmark
#: By offset of the last character: the offsets of a subsequence, and its weight.
SHAPES = [((0, *c, s), DECAY**s) for s in range(LENGTH - 1, SPAN) for c in combinations(range(1, s), LENGTH - 2)]
SPACED = re.compile(r"(?<!\S)\w(?:[ _.*-]\w){3,}(?!\S)")
NOISE = re.compile(r"[\W_]+")
AROUND = re.compile(r"^[\W_]+|[\W_]+$")
ENDS = (".", "!", "?")
BIG = 1 << 20
TOGETHER = 1_000_000  # characters of texts that are scored together
TOP = 4
MOST_TEXTS = 3  # of a labelled id that rows share, to learn from
WORDS = 24  # tokens of a sentence at most: what is longer is several


def cleaned(token: str) -> str:
    return NOISE.sub("", token)


def bare(token: str) -> str:
    """A token without what isn't a letter or digit at its ends; its forms are the token's."""
    return token if token.isalnum() else AROUND.sub("", token)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, value): the weighted distinct subsequences of each of at most 4,096 words, of length 1 together, sorted by word."""
    n = len(words)
    marked = [f"^{w}$" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(n), size)
    left = np.repeat(start + size, size) - np.arange(len(flat))  # characters from here to the word's end
    own, codes, values = [], [], []
    for offsets, weight in SHAPES:
        at = np.flatnonzero(left > offsets[-1])
        code = flat[at]
        for o in offsets[1:]:
            code = code * np.uint64(0x9E3779B97F4A7C15) + flat[at + o]
            code ^= code >> np.uint64(29)
        own.append(of[at])
        codes.append(code)
        values.append(np.full(len(at), weight))
    # one number a subsequence, the word in its high 12 bits, so that one sort puts equal ones together
    key = (np.concatenate(own).astype(np.uint64) << np.uint64(52)) | (np.concatenate(codes) & np.uint64((1 << 52) - 1))
    order = np.argsort(key)
    key, value = key[order], np.concatenate(values)[order]
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, value = key[first], np.add.reduceat(value, first)
    word, code = (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)
    norm = np.sqrt(np.bincount(word, value * value, n))
    return word, code, value / norm[word]


class Kernel:
    """Kernels of tokens with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        word, code, value = features(landmarks)
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), self.n), np.float32)
        self.table[at, word] = value

    def rows(self, tokens: list[str]) -> np.ndarray:
        """By token and landmark: the kernel of the nearest of the token's forms."""
        out = np.zeros((len(tokens), self.n), np.float32)
        for a in range(0, len(tokens), 4096):
            own = [forms(t) for t in tokens[a : a + 4096]]
            at: dict[str, int] = {}
            place = np.array([at.setdefault(w, len(at)) for x in own for w in x], np.int64)
            size = np.array([len(x) for x in own], np.int64)
            start = np.cumsum(size) - size
            found = self.plain(list(at))
            if len(place) == len(own):
                out[a : a + len(own)] = found[place]
                continue
            for lo in range(0, len(own), 512):  # what a few tokens' forms give, so that a long token's many don't lie beside all others
                hi = min(len(own), lo + 512)
                end = start[hi] if hi < len(own) else len(place)
                out[a + lo : a + hi] = np.maximum.reduceat(found[place[start[lo] : end]], start[lo:hi] - start[lo], axis=0)
        return out

    def plain(self, words: list[str]) -> np.ndarray:
        """By word and landmark, each word as it is."""
        out = np.zeros((len(words), self.n), np.float32)
        for i in range(0, len(words), 4096):
            word, code, value = features(words[i : i + 4096])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == code) if len(code) else np.zeros(0, np.int64)
            if not len(hit):
                continue
            word, value, at = word[hit], value[hit], at[hit]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            for j in range(0, len(first), 512):
                a, b = first[j], (first[j + 512] if j + 512 < len(first) else len(word))
                out[i + word[first[j : j + 512]]] = np.add.reduceat(self.table[at[a:b]] * value[a:b, None].astype(np.float32), first[j : j + 512] - a, axis=0)
        return out**POWER


def forms(token: str) -> list[str]:
    """What a token is compared as; the form nearest to a landmark counts for it.

    Of its letters without separators, and of each part between separators, all windows of 12 characters (every second one) and of 40
    (every tenth), the last one up to the end; what is shorter is a window as a whole. So a word inside a longer token is met alike
    whatever the token's length."""
    if len(token) <= WINDOWS[0][0] and token.isalnum():
        return [token]
    out = {}
    for w in dict.fromkeys([cleaned(token), *filter(None, NOISE.split(token))]):
        for size, step in WINDOWS:
            out.update((w[i : i + size], None) for i in (*range(0, len(w) - size, step), max(0, len(w) - size)))
    return list(out)


def tokens_of(text: str) -> list[str]:
    """Tokens of a text, a full stop for each line's end; runs of single characters come again as one word each."""
    low = text.lower()
    return low.replace("\n", " . ").split() + [t for m in SPACED.finditer(low) for t in (".", cleaned(m[0]))]


def starts_of(ends: np.ndarray) -> np.ndarray:
    """Where sentences begin: after each token that ends one, and after every WORDS tokens of one."""
    at = np.arange(len(ends))
    first = np.concatenate([[True], ends[:-1]])
    return np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % WORDS == 0)


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence that hold a letter or digit, without what stands around them."""
    tokens = tokens_of(text)
    if not tokens:
        return []
    starts = [*starts_of(np.array([t.endswith(ENDS) for t in tokens])).tolist(), len(tokens)]
    out = [[w for t in tokens[a:b] if (w := bare(t))] for a, b in zip(starts, starts[1:])]
    return [s for s in out if s]


class Model:
    """weights: by landmark, of a word's kernel values; bias: of a sentence; slopes and shift: of the logistic of the TOP highest sentences."""

    def __init__(self, kernel: Kernel | None, weights=None, bias: float = 0.0):
        self.kernel, self.weights, self.bias = kernel, weights, bias
        self.slopes, self.shift = np.zeros(TOP), 0.0
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def learn(self, tokens: list[str]) -> None:
        """A token's share of its sentence's score, BIG more if it ends one."""
        own = [bare(t) for t in tokens]
        words = list(dict.fromkeys(own))
        share = dict(zip(words, (self.kernel.rows(words) @ self.weights).tolist()))
        for t, w in zip(tokens, own):
            self.memo[t] = (share[w] if w else 0.0) + (BIG if t.endswith(ENDS) else 0)

    def margins_all(self, texts: list[str], most: int = 400_000) -> np.ndarray:
        """By text: the TOP highest sentences' scores, from the highest on; a sentence without words for each that lacks.

        What the texts' tokens lack in the memo is learned together; the memo holds `most` tokens, or those of these texts."""
        split = [tokens_of(t) for t in texts]
        new = dict.fromkeys(t for x in split for t in x if t not in self.memo)
        if len(self.memo) + len(new) > most:
            self.memo.clear()
            new = dict.fromkeys(t for x in split for t in x)
        new = list(new)
        for i in range(0, len(new), 100_000):
            self.learn(new[i : i + 100_000])
        out = np.full((len(texts), TOP), self.bias)
        for row, tokens in zip(out, split):
            if tokens:
                v = np.array([self.memo[t] for t in tokens])
                ends = v > BIG / 2
                v = v - BIG * ends
                best = np.sort(np.add.reduceat(v, starts_of(ends)))[::-1][:TOP] + self.bias
                row[: len(best)] = best
        return out

    def margins(self, text: str) -> np.ndarray:
        return self.margins_all([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        """The score of each text; about TOGETHER characters of them are worked on at once."""
        if self.kernel is None:
            return [0.0] * len(texts)
        out: list[float] = []
        held, size = [], 0
        for i, t in enumerate(texts, 1):
            held.append(t or "")
            size += len(held[-1])
            if size > TOGETHER or i == len(texts):
                out += (1 / (1 + np.exp(-np.clip(self.margins_all(held) @ self.slopes + self.shift, -30, 30)))).tolist()
                held, size = [], 0
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _landmarks(toxic: list[list[list[str]]], clean: list[list[list[str]]], n: int) -> tuple[list[str], int]:
    """Words with the beginnings that set toxic documents apart, and how many; then common clean words.

    Beginnings, whole words among them, are ranked by the log-likelihood ratio of their documents' classes, so that a stem
    counts over all words that it begins. As so many are tried, the ratio must exceed what chance gives the best of them.
    Of those that begin alike the first stands, and gives the words that most toxic documents hold."""
    sets = [[{w for s in d for w in s if len(w) <= LONGEST} for d in docs] for docs in (toxic, clean)]
    t, c = (Counter(w for ws in docs for w in ws) for docs in sets)
    heads = lambda w: {f"{w}$"[:k] for k in range(3, min(len(w) + 1, 9) + 1)}
    held = [Counter(g for ws in docs for g in {g for w in ws for g in heads(w)}) for docs in sets]
    n1, n0 = len(toxic), len(clean)
    share = n1 / (n1 + n0)

    def ratio(g: str) -> float:
        k1, k0 = held[0][g], held[1][g]
        if k1 <= share * (k1 + k0):
            return 0.0
        return 2 * (k1 * np.log(k1 / (share * (k1 + k0))) + (k0 * np.log(k0 / ((1 - share) * (k1 + k0))) if k0 else 0))

    ratios = {g: r for g in held[0] if (r := ratio(g)) > 0}
    least = 2 * np.log(len(held[0]) + len(held[1]) + 1) + 4
    ranked = sorted(ratios, key=lambda g: (-ratios[g], -len(g), g))
    stems: list[str] = []
    for i, g in enumerate(ranked):
        if len(stems) >= n or (ratios[g] < least and i >= 10):
            break
        if not any(g.startswith(x) or (x.startswith(g) and held[0][g] < 1.5 * held[0][x]) for x in stems):
            stems.append(g)
    of: dict[str, list[str]] = {g: [] for g in stems}
    for w in sorted(t, key=lambda w: (-(t[w] / n1 - c[w] / n0), w)):
        for g in heads(w):
            if g in of:
                of[g].append(w)
    telling: dict[str, None] = {}
    for turn in range(8):
        for g in stems:  # the words that make up most of what begins so
            seen = sum(t[w] for w in of[g][:turn])
            if len(telling) < n * 3 // 4 and len(of[g]) > turn and seen < 0.7 * held[0][g] and t[w := of[g][turn]] / n1 > 2 * c[w] / n0:
                telling[w] = None
    common = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w not in telling and len(w) > 2]
    return [*telling, *common[: n - len(telling)]], len(telling)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20, shrink: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias for the squared hinge loss, by Newton steps over the sentences within the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.append(np.full(x.shape[1], shrink), 1e-8))
    w, inside = np.zeros(x1.shape[1]), np.ones(len(x), bool)
    for _ in range(rounds):
        own = x1[inside] * cost[inside, None]
        w = np.linalg.solve(own.T @ x1[inside] + ridge, own.T @ y[inside])
        now = y * (x1 @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def train(toxic: list[str], clean: list[str], landmarks: int = 128, rounds: int = 3, sentences_most: int = 30_000) -> Model:
    """From whole texts of toxic and clean documents; of the clean ones' sentences, `sentences_most` at most are drawn for the machine, all of them for landmarks."""
    if not toxic or not clean:
        return Model(None)
    split = [[sentences(t) for t in docs] for docs in (toxic, clean)]
    marks, n_telling = _landmarks(*([[[cleaned(t) for t in s] for s in d] for d in docs] for docs in split), landmarks)
    if not n_telling:
        return Model(None)
    kernel = Kernel(marks)
    among = kernel.plain(marks).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-4 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    rng = np.random.default_rng(5)
    clean_sentences = [s for d in split[1] for s in d]
    split[1] = [[clean_sentences[i]] for i in rng.permutation(len(clean_sentences))[:sentences_most]]
    words = sorted({w for docs in split for d in docs for s in d for w in s})
    place = {w: i for i, w in enumerate(words)}
    mapped, near = np.zeros((len(words), root.shape[1]), np.float32), np.zeros(len(words), np.float32)
    for i in range(0, len(words), 20_000):
        rows = kernel.rows(words[i : i + 20_000])
        mapped[i : i + 20_000], near[i : i + 20_000] = rows @ root, rows[:, :n_telling].max(1)

    def matrix(docs):
        flat = [s for d in docs for s in d]
        out = np.zeros((len(flat), mapped.shape[1]))
        for i, s in enumerate(flat):
            out[i] = mapped[[place[w] for w in s]].sum(0)
        return out, np.cumsum([0] + [len(d) for d in docs])

    (xt, at), (xc, _) = matrix(split[0]), matrix(split[1])
    # the first witness: the sentence with the word nearest to a telling landmark
    first = np.array([max(near[place[w]] for w in s) for d in split[0] for s in d])
    score = first
    w, bias = np.zeros(xt.shape[1]), 0.0
    for _ in range(rounds):
        chosen = [a + int(score[a:b].argmax()) for a, b in zip(at, at[1:]) if b > a]
        x = np.vstack([xt[chosen], xc])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(xc))])
        cost = np.concatenate([np.full(len(chosen), 0.5 / max(1, len(chosen))), np.full(len(xc), 0.5 / max(1, len(xc)))])
        w, bias = _svm(x, y, cost)
        score = xt @ w
    model = Model(kernel, (root @ w).astype(np.float32), bias)
    x = np.vstack([model.margins_all((toxic + clean)[i : i + 100]) for i in range(0, len(toxic) + len(clean), 100)])
    label = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    model.slopes, model.shift = _logistic(x, label, np.where(label == 1, max(1.0, len(clean) / len(toxic) / 3), 1.0))
    return model


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 30, shrink: float = 1.0) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift, by Newton steps."""
    use = np.ones(x.shape[1], bool)
    while True:
        x1 = np.hstack([x * use, np.ones((len(x), 1))])
        w = np.zeros(x1.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            ridge = np.append(np.full(x.shape[1], shrink), 1e-6)
            w = w + np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (weight * (label - p)) - ridge * w)
        if (w[:-1] >= 0).all():
            return w[:-1], float(w[-1])
        use &= w[:-1] >= 0


def fit(docs: DataFrame, labels: DataFrame, each: int = 1_500, longest: int = 20_000, sentences_most: int = 30_000) -> Model:
    """Trained on `each` toxic documents and twice as many clean ones at most, in the order of a hash of the id, of `longest` characters
    at most, and on `sentences_most` sentences of the clean ones at most.

    docs: doc_id, text; labels: doc_id, toxic. Both hold what may be learned from only. An id with both labels is toxic; rows that repeat
    an id and its text count once, and of an id's different texts the MOST_TEXTS least by hash."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, each), (0, 2 * each))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # 3 * `each` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= longest).join(ids, "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= MOST_TEXTS).orderBy("toxic", "doc_id", "text").collect()  # 3 * `each` * MOST_TEXTS
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], sentences_most=sentences_most)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then score."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sent.value.scores(b.column(b.num_columns - 1).to_pylist()), pa.float64())],
                names=[*b.schema.names[:-1], "score"]
            )

    return own.mapInArrow(run, (schema + ", " if keep else "") + "score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows whose crc32 modulo 4 is not 2."""
    taught = crc_mod("doc_id", 4) != 2
    model = fit(docs.where(taught), labels.where(taught))
    return score(docs.withColumn("held_out", crc_mod("doc_id", 4) == 2), model, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
