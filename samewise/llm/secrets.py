"""Secret scan: three base patterns, and sliding-window Shannon entropy over candidate strings with an allow-list.

Each window has a character class of its own, and must have the bits of that class; windows that overlap make one span.
Candidates are cut at '='; windows that touch a placeholder are left out, the others of the candidate stay.

Spans are (kind, start, end) in code points, end exclusive. Null texts count as empty and have no spans; whole texts of
any length are scanned; repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches

#: Base patterns and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # one match is the whole run, so a length bound here and a filter after are alike
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_SIGNS = ("passw", "secret", "token", "api")  # each match holds one of these, in some case

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[^=]{20,}")
WINDOW = 20
#: Bits a character: what a window must have, by character class.
LEAST_BITS = {"hex": 2.9, "lower": 3.6, "upper": 3.6, "alnum": 3.6, "base64": 3.6, "letters": 3.9}
LEAST_SWITCHES = 3  # between letters and digits, or cases: words, numbers and names joined have fewer
#: Candidates that look random but are public: UUIDs, content hashes under their name, addresses, placeholders.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(1|256|384|512)-[A-Za-z0-9+/_-]+")
PLACEHOLDER = re.compile(r"EXAMPLE|example|sample|placeholder|changeme|0?123456789|abcdefghij|ABCDEFGHIJ")
#: After one of these nothing of a token is a secret: addresses, and hashes under their name.
ALLOWED_BEFORE = re.compile(r"@|www\.|urn:uuid:|sha1:|sha256:|md5:|:(?=//)", re.I | re.A)
TOKEN = re.compile(r"""[^\s"'`,;|<>()\[\]{}]{20,}""")  # what a candidate lies in, whole; texts are walked through once
SLASHES = re.compile(r"^//+")
XLOGX = [0.0] + [i * math.log2(i) for i in range(1, WINDOW + 2)]  # a window and the character that comes


def char_class(s: str) -> str | None:
    """The class of a window: hex, lower or upper (with digits), alnum, base64 or letters; None for what prose, numbers and separators are made of."""
    digits = sum(c.isdigit() for c in s)
    if digits == len(s) or len(set(s)) < 8:
        return None
    lower, upper = re.search("[a-z]", s), re.search("[A-Z]", s)
    if not s.isalnum():
        return "base64" if digits and lower and upper else None
    if not digits:
        return "letters"
    if lower and upper:
        return "alnum"
    if switches(s) < LEAST_SWITCHES:
        return None
    return "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "lower" if lower else "upper"


def switches(s: str) -> int:
    """How often a letter follows a digit, or a digit a letter."""
    return sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))


def bits(s: str):
    """The start and the bits a character of each window of s.

    The counts and the sum of n log n change by the character that comes and the one that goes."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += XLOGX[n + 1] - XLOGX[n]
        if i >= WINDOW:
            gone = s[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += XLOGX[n - 1] - XLOGX[n]
        if i >= WINDOW - 1:
            yield i - WINDOW + 1, math.log2(WINDOW) - total / WINDOW


def random_windows(s: str, least: float) -> tuple[int, int] | None:
    """From the first window's start to the last one's end, among windows with at least `least` bits a character."""
    found = [i for i, b in bits(s) if b >= least]
    return (found[0], found[-1] + WINDOW) if found else None


def random_parts(s: str) -> list[tuple[int, int]]:
    """Runs of overlapping windows with the bits of their class that touch no placeholder."""
    held = [m.span() for m in PLACEHOLDER.finditer(s)]
    lowest = min(LEAST_BITS.values())
    out: list[tuple[int, int]] = []
    k = 0
    for i, b in bits(s):
        while k < len(held) and held[k][1] <= i:
            k += 1
        if b < lowest or (k < len(held) and held[k][0] < i + WINDOW) or (kind := char_class(s[i : i + WINDOW])) is None or b < LEAST_BITS[kind]:
            continue
        out[-1:] = [(out[-1][0], i + WINDOW)] if out and i < out[-1][1] else [*out[-1:], (i, i + WINDOW)]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_SIGNS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of random windows that touch no base span and that the allow-list doesn't suppress."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)  # the spans before it begin before the end
        return not k or reach[k - 1] <= s

    for t in TOKEN.finditer(text):
        public = ALLOWED_BEFORE.search(t[0])
        for m in CANDIDATE.finditer(t[0], 0, public.end() if public else len(t[0])):  # neither lies across such a sign: '@', ':' and '.' part candidates
            for piece in PIECE.finditer(m[0]):
                own = SLASHES.sub("", piece[0])  # of a comment
                if len(own) < WINDOW or ALLOWED.fullmatch(own) or not (parts := random_parts(own)):
                    continue
                at = t.start() + m.start() + piece.end() - len(own)
                out += [("entropy", at + s, at + e) for s, e in parts if free(at + s, at + e)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = entropy_spans(text, base)
                kinds = [s[0] for s in base]
                out.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, [pa.int64()] * 4 + [pa.string()] * 2))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    )
