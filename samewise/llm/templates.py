"""Line dedup by a log-template tree: token count and leading tokens lead to a leaf, whose variable fields become wild.

A line is what stands between line feeds; its tokens stand between ASCII white space; a token with a digit is wild from
the start. The tree has a fixed depth: token count, then `LEAD` leading tokens. In a leaf, each token has a level: how often the
number of documents that have it at its position is `least_docs` doubled. At each level of a line, the tokens of lower levels
are variable fields, and lines whose other tokens agree are of one template, if these are at least `LEAST_FIXED` of the line and
as many documents as the level says have them together; besides, each line is a template of its own. So a field's words may
recur in any number of documents, as long as the words around it do in at least twice as many.

A template recurs if it is in `least_docs` documents of different text. Lines of `LONG` tokens, which don't recur by chance, need
two; short lines, which do, need `SHORT_DOCS`, and those of one or two tokens `TINY_SHARE` of all documents besides.
Of the recurring templates of a line the most general counts. Of its lines, those in the document of least doc_id stay, the
others go: what recurs stays once.

All counts are sums over all documents; no leaf is gathered in one task. Lines of one or two tokens without a letter, such as numbers and rules, stay.
Null texts stay null; documents without a doc_id count as the one that comes last, and keep a recurring line only if no other
holds it; repeated rows are treated alike; other columns pass through untouched, whatever their names; an empty table gives no rows."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, cut, free_name, tidy

LEAD, LEAST_TOKENS, SHORT, SHORT_DOCS, LEAST_FIXED = 3, 3, 6, 20, 0.6
LONG, LONG_DOCS, TINY_SHARE = 20, 2, 0.05
WILD = "<*>"
DIGIT = re.compile(r"[0-9]")
SPACE = " \t\x0b\x0c\r"
MOST_MARKS = 10_000_000  # lines that go, of all documents, whose places are broadcast at most: some 40 MB


def tokens(line: str) -> list[str]:
    """The tokens of a line, those with a digit as WILD."""
    # ASCII white space only, as in SQL: str.split() would also cut at others
    own = [t.decode() for t in line.encode("utf-8", "replace").split()]
    return [WILD if DIGIT.search(t) else t for t in own] if DIGIT.search(line) else own


def hashed(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def _lines(docs: DataFrame, with_text: bool) -> DataFrame:
    """row (hash of doc_id and text), doc_id, body (hash of the text), line, leaf, shape (hash of the line's tokens), n_tokens, and the tokens joined by spaces."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for row, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_py()
                body = hashed(text)
                for k, line in enumerate(text.split("\n")):
                    own = tokens(line)
                    if len(own) >= LEAST_TOKENS or any(c.isalpha() for t in own if t != WILD for c in t):
                        joined = " ".join(own)
                        out.append((row, doc, body, k, hashed(f"{len(own)} {' '.join(own[:LEAD])}"), hashed(joined), len(own), *([joined] if with_text else [])))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *([pa.string()] if with_text else [])]
    names = ["row", "doc_id", "body", "line", "leaf", "shape", "n_tokens", *(["joined"] if with_text else [])]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    own = docs.select(_row().alias("row"), _doc().alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return own.mapInArrow(tidy(run), "row long, doc_id long, body long, line int, leaf long, shape long, n_tokens int" + ", joined string" * with_text)


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _doc():
    """The doc_id; without one, the highest that there can be."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def recurring(docs: DataFrame, least_docs: int = 3, most: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(lines, going): all lines, and (leaf, shape, keeper) of the lines of recurring templates; keeper: the doc_id that keeps them."""
    bounded_batches(docs.sparkSession)
    lines = cut(_lines(docs, False), "lines")
    shapes = lines.groupBy("leaf", "shape", "body", "n_tokens").agg(F.min("doc_id").alias("keeper"))
    shapes = cut(shapes.groupBy("leaf", "shape", "n_tokens").agg(F.count("*").alias("docs"), F.min("keeper").alias("keeper")), "shapes")
    leaves = shapes.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("n")).where(F.col("docs") >= least_docs)
    mixed = cut(leaves.where("n > 1").select("leaf"), "mixed")
    # the text of lines in leaves with several shapes, each shape once
    texts = _lines(docs, True).select("leaf", "shape", "joined").join(_small(mixed, most), "leaf", "left_semi").groupBy("leaf", "shape").agg(F.first("joined").alias("joined"))
    own = cut(texts.join(shapes, ["leaf", "shape"]).select("leaf", "shape", "docs", "n_tokens", "joined"), "mixed-shapes")
    at = own.select("leaf", "shape", "docs", F.posexplode(F.split("joined", " ")).alias("at", "token"))
    level = F.floor(F.log2(F.col("n") / least_docs) + 1e-9).cast("int").alias("level")
    fixed = at.where(F.col("token") != WILD).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs).select("leaf", "at", "token", level)
    kept = at.join(fixed, ["leaf", "at", "token"]).select("leaf", "shape", "level", "at", "token").repartition("leaf", "shape").groupBy("leaf", "shape", "level")
    kept = kept.agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("at", "token")).alias("a"), F.sum(F.xxhash64("token", "at").cast("decimal(38,0)")).alias("b"))
    # the tokens of a level and of those above it
    above = Window.partitionBy("leaf", "shape").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.select(
        "leaf", "shape", "level", F.sum("fixed").over(above).alias("fixed"), F.bit_xor("a").over(above).alias("a"),
        F.sum("b").over(above).cast("decimal(38,0)").alias("b")
    )
    general = own.select("leaf", "shape", "n_tokens").join(kept, ["leaf", "shape"]).where(F.col("fixed") >= LEAST_FIXED * F.col("n_tokens"))
    general = shapes.join(general.select("leaf", "shape", "level", F.xxhash64("level", "fixed", "a", "b").alias("template")), ["leaf", "shape"])
    columns = ["leaf", "shape", "n_tokens", "docs", "keeper", "level", "template"]
    of_shape = cut(shapes.select("*", F.lit(-1).alias("level"), F.col("shape").alias("template")).select(columns).unionByName(general.select(columns)), "templates")
    # a document may have several shapes of one template, so documents are counted anew where there are several shapes
    several = of_shape.groupBy("leaf", "template").agg(
        F.count("*").alias("n"), F.sum("docs").alias("docs"), F.min("keeper").alias("keeper"), F.max("n_tokens").alias("n_tokens"),
        F.max("level").alias("level")
    )
    tiny = max(SHORT_DOCS, math.ceil(TINY_SHARE * docs.where("text is not null").count()))
    enough = F.when(F.col("n_tokens") < LEAST_TOKENS, tiny).when(F.col("n_tokens") < SHORT, SHORT_DOCS).when(
        F.col("n_tokens") >= LONG, min(LONG_DOCS, least_docs)
    ).otherwise(least_docs)
    hopeful = cut(several.where((F.col("docs") >= enough) & ((F.col("level") < 0) | (F.col("docs") >= least_docs * F.pow(F.lit(2), F.col("level"))))), "templates")
    again = of_shape.join(hopeful.where("n > 1").select("leaf", "template"), ["leaf", "template"]).select("leaf", "shape", "template")
    exact = lines.select("leaf", "shape", "body").join(again, ["leaf", "shape"]).select(
        "leaf", "template", "body"
    ).distinct().groupBy("leaf", "template").agg(F.count("*").alias("exact"))
    sure = hopeful.join(exact, ["leaf", "template"], "left").where(F.coalesce("exact", "docs") >= enough).select("leaf", "template", "keeper")
    # what agrees at a level agrees at those above it, so all lines of a template have the same most general one
    best = of_shape.select("leaf", "shape", "level", "template").join(sure, ["leaf", "template"]).groupBy("leaf", "shape").agg(F.max_by("keeper", "level").alias("keeper"))
    return lines, cut(best, "going")


def clean(docs: DataFrame, least_docs: int = 3, most: int = 500_000) -> DataFrame:
    """docs with the lines of recurring templates out of `text`, and n_lines_dropped."""
    lines, going = recurring(docs, least_docs, most)
    gone = lines.join(_small(going, most), ["leaf", "shape"]).where(F.col("doc_id") != F.col("keeper"))
    counted, key, row, marks = (free_name(docs, n) for n in ("n_lines_dropped", "key", "row", "marks"))
    by_row = cut(gone.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set("line")).alias(marks)), "dropped")  # at most a document's own lines
    n, n_marks = by_row.agg(F.count("*"), F.coalesce(F.sum(F.size(marks)), F.lit(0))).first()
    joined = docs.withColumn(key, _row()).join(F.broadcast(by_row) if n <= most and n_marks <= MOST_MARKS else by_row, F.col(key) == F.col(row), "left")
    # a mark for each line up to the last that goes, from the distances between those that go: one pass over the text's lines
    at = F.col(marks)
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    flags = F.flatten(F.zip_with(at, before, lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))))
    pairs = F.zip_with(F.split(F.col("text").cast("string"), "\n"), flags, lambda s, g: F.struct(s.alias("s"), g.alias("g")))
    left = F.transform(F.filter(pairs, lambda x: ~F.coalesce(x["g"], F.lit(False))), lambda x: x["s"])
    text = F.when(F.col(marks).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.size(marks), F.lit(0)).cast("long").alias(counted))
