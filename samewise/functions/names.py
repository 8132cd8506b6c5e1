"""Name normalization as Catalyst expressions, with a trace of the rules that changed something."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, in the order in which they apply. Java's \s is ASCII without (?U).
INVERTED = r"(?U)^\s*([^,]+?)\s*,\s*([^,]+?)\s*$"
THE = r"(?U)^the\s+"
HONORIFIC = r"(?U)(?:^|\s)(?:jr\.?|sr\.?|iii|mr\.?|ms\.?|dr\.?)(?=\s|$|,|\.)"
INITIAL = r"(?U)\s+[a-z]\.?(?=\s)"
LEGAL = r"(?U)(?:,\s*|\s+)(?:limited\s+liability\s+company|l\.l\.c\.?|llc\.?|inc\.?|corp\.?|ltd\.?|llp\.?)(?=\s|$|\.|,)"
QUALIFIER = r"(?U)\s*\([^)]*\)"
PUNCTUATION = r"""[.,;:!?"'`]"""
SPACES = r"(?U)\s+"
NEVER = "(?!)"  # matches nothing
#: The category of each source.
CATEGORIES = {"quickbooks": "accounting", "ruddr": "psa"}


@cache
def _mark_table() -> tuple[str, str]:
    """Characters that lose their marks and what is left of them, for translate(); bare marks come last and go.

    Built from Unicode's canonical decompositions. Hangul composes back to itself, so it isn't in the table."""
    own, left, marks = [], [], []
    for code in range(0x80, 0x30000):
        if 0xAC00 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif (d := unicodedata.normalize("NFD", c)) != c:
            bare = unicodedata.normalize("NFC", "".join(x for x in d if not unicodedata.combining(x)))
            if len(bare) == 1 and bare != c:
                own.append(c)
                left.append(bare)
    return "".join(own + marks), "".join(left)


def strip_marks(name: Column) -> Column:
    """Decomposed, without combining marks, composed again."""
    return F.translate(name, *_mark_table())


def category_of(source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(c)) for s, c in CATEGORIES.items()], F.lit(""))


def blank(name: Column) -> Column:
    return name.isNull() | (F.regexp_replace(name, SPACES, "") == "")


def normalize(entities: DataFrame, name: str = "display_name", category: str = "entity_category") -> DataFrame:
    """entities with normalized_name, rules_applied, email_is_person, category and reject_reason (null where the name is good).

    Each step names the one before it once, so that the optimizer can merge them without the expression growing by
    powers. A blank name, or one of which nothing is left, is a rejected row and never fails the job."""
    raw = F.coalesce(F.col(name), F.lit(""))
    person = F.coalesce(F.col(category) == "person", F.lit(False))
    out = entities.withColumn("__raw", raw).withColumn("__person", person)
    steps: list[tuple[str, Column]] = []

    def step(rule: str, to: Column, traced: Column | None = None) -> None:
        nonlocal out
        now = f"__{len(steps) + 1}"
        out = out.withColumn(now, to)
        steps.append((rule, F.col(now) != F.col(before()) if traced is None else traced))

    def before() -> str:
        return f"__{len(steps)}" if steps else "__raw"

    one_comma = F.length(F.col("__raw")) - F.length(F.replace(F.col("__raw"), F.lit(","), F.lit(""))) == 1
    inverts = F.col("__person") & one_comma & F.col("__raw").rlike(INVERTED)
    step("person_inversion", F.when(inverts, F.regexp_replace("__raw", INVERTED, "$2 $1")).otherwise(F.col("__raw")), inverts)
    step("strip_diacritics", strip_marks(F.col(before())))
    step("lowercase", F.lower(F.col(before())), F.lit(True))
    step("strip_the", F.regexp_replace(before(), THE, ""), F.col(before()).rlike(THE))
    step("strip_honorific", F.regexp_replace(F.regexp_replace(before(), HONORIFIC, " "), HONORIFIC, " "), F.col(before()).rlike(HONORIFIC))
    step("strip_middle_initial", F.regexp_replace(F.col(before()), F.when(F.col("__person"), INITIAL).otherwise(NEVER), F.lit(" ")),
        F.col("__person") & F.col(before()).rlike(INITIAL))
    step("strip_legal_suffix", F.regexp_replace(F.regexp_replace(before(), LEGAL, ""), LEGAL, ""), F.col(before()).rlike(LEGAL))
    step("strip_paren_qualifier", F.regexp_replace(before(), QUALIFIER, ""), F.col(before()).rlike(QUALIFIER))
    step("ampersand_to_and", F.replace(F.col(before()), F.lit("&"), F.lit(" and ")))
    step("strip_punctuation", F.regexp_replace(before(), PUNCTUATION, " "))
    step("collapse_whitespace", F.regexp_replace(F.regexp_replace(before(), SPACES, " "), "^ | $", ""), F.lit(True))
    trace = F.filter(F.array(*[F.when(changed, F.lit(rule)) for rule, changed in steps]), lambda r: r.isNotNull())
    reason = F.when(blank(F.col(name)), "empty or missing display_name").when(F.col(before()) == "",
        "name became empty after normalization")
    out = out.withColumn("normalized_name", F.col(before())).withColumn("rules_applied", trace).withColumn("reject_reason",
        reason).withColumn("email_is_person", F.col("__person"))
    if "source" in entities.columns:
        out = out.withColumn("category", category_of(F.col("source")))
    return out.drop("__raw", "__person", *[f"__{k + 1}" for k in range(len(steps))])


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return normalized.where("reject_reason is null").drop("reject_reason"), normalized.where("reject_reason is not null")
