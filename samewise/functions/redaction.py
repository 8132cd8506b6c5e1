"""Shapes of codes, prompts without identifying text, and leak checks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samewise.functions.similarity import tokens, two_places

LEAST_TOKEN = 3
#: What stands for a reasoning that leaks, and the forms of class and project codes.
PLACEHOLDER = "[redacted: PII detected in LLM output]"
CLASS_CODE, PROJECT_CODE = r"^[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+$", r"^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+$"
#: The keys of a payload, the first non-empty string of which counts.
EMAIL_KEYS = ("email", "Email", "PrimaryEmail", "primary_email")
EMPLOYEE_KEYS = ("employee_id", "EmployeeId", "EmployeeNumber", "employee_number")
ROLE_KEYS = ("role", "Role", "title", "Title", "job_title")
CLASS_KEYS = ("class", "Class", "class_code", "ClassCode")
PROJECT_KEYS = ("project_code", "ProjectCode", "project_id", "ProjectId")


def class_shape(code: Column) -> Column:
    """a.b.c as A.B.C, a letter for each segment (AA, AB after Z); null for what isn't such a code."""
    letter = lambda i: F.chr(F.lit(65) + i % 26)
    names = F.transform(F.split(code, r"\."), lambda _,
        i: F.when(i < 26, letter(i)).otherwise(F.concat(F.chr(F.lit(64) + F.floor(i / 26)), letter(i))))
    return F.when(code.rlike(CLASS_CODE), F.array_join(names, "."))


def project_shape(code: Column) -> Column:
    """Each segment as an A for every letter, then an N for every digit; null for what isn't such a code."""
    count = lambda s, other: F.length(F.regexp_replace(s, other, ""))
    parts = F.transform(F.split(code, "-"),
        lambda s: F.concat(F.repeat(F.lit("A"), count(s, "[^A-Za-z]")), F.repeat(F.lit("N"), count(s, "[^0-9]"))))
    return F.when(code.rlike(PROJECT_CODE), F.array_join(parts, "-"))


def leak(text: Column, forbidden: Column) -> Column:
    """The least forbidden token of three characters or more that the text holds, whatever its case; else null."""
    needle = lambda t: F.lower(F.trim(t))
    found = F.filter(F.array_sort(forbidden), lambda t: (F.length(needle(t)) >= LEAST_TOKEN) & F.contains(F.lower(text), needle(t)))
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared tokens, all tokens but 1 at least)."""
    x, y = tokens(a), tokens(b)
    return F.size(F.array_intersect(x, y)), F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def inverted(a: Column, b: Column) -> Column:
    """The same tokens in another order."""
    x, y = tokens(a), tokens(b)
    return (F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y))) & (x != y)


def prompt(person: Column, source: Column, target: Column, source_kind: Column, target_kind: Column, class_code: Column,
    project_code: Column, swapped: Column, shared: Column, total: Column, score: Column) -> Column:
    """The text shown to a reviewer or model. Its sentences are fixed values; no name, address or code enters it."""
    middle = (F.concat(F.lit("Normalized-token overlap: "), shared.cast("string"), F.lit("/"), total.cast("string"),
        F.lit(" tokens match.")), F.concat(F.lit("Stage 3 pairwise score: "), two_places(score), F.lit(".")))
    organization = F.concat_ws(
        " ",
        F.concat(F.lit("Entity A is an organization from the "), source, F.lit(" category (type: "), source_kind, F.lit(").")),
        F.concat(F.lit("Entity B is an organization from the "), target, F.lit(" category (type: "), target_kind, F.lit(").")),
        F.concat(F.lit("Entity A has a class-code pattern of "), class_code, F.lit(".")),
        F.concat(F.lit("Entity B has a project-code pattern of "), project_code, F.lit(".")),
        *middle,
        F.lit("Are Entity A and Entity B the same organization?"),
    )
    role = lambda k: F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown"))
    people = F.concat_ws(
        " ",
        F.concat(F.lit("Person A is from the "), source, F.lit(" category with role="), role(source_kind), F.lit(".")),
        F.concat(F.lit("Person B is from the "), target, F.lit(" category with role="), role(target_kind), F.lit(".")),
        F.when(swapped,
            F.lit("A name-inversion pattern was detected between the two normalized forms (e.g., 'Last, First' on one side vs "
                  "'First Last' on the other).")),
        *middle,
        F.lit("Are Person A and Person B the same individual?"),
    )
    return F.when(person, people).otherwise(organization)
