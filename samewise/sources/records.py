"""Record sources: JSON arrays of the accounting and PSA systems, their filters, and the mapping to common rows.

A missing file or one that is no list of records is an error of the reader; an unknown kind is a ValueError. Python's "or" of
the record formats counts '' and 0 as missing, as _or() does."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.functions.names import normalize

#: The names of record kinds and what they are in each system.
KINDS = {
    "accounting": {"customer": "Customer", "client": "Customer", "vendor": "Vendor", "person": "Employee", "employee": "Employee"},
    "psa": {"client": "client", "vendor": "vendor", "person": "team-member", "team-member": "team-member", "resource": "team-member"},
}
SOURCES = {"accounting": "quickbooks", "psa": "ruddr"}
PEOPLE = {"accounting": "Employee", "psa": "team-member"}
TRANSACTIONS = ("Invoice", "Payment", "Bill")
OPERATIONS = ("create", "update", "void")

#: Windows of time that one task counts calls of.
STRETCH = 64

PROJECTS = "array<struct<code:string,name:string,status:string,budget_hours:bigint,logged_hours:double,hourly_rate:double,department:string>>"
ENTITY_SCHEMA = {
    "accounting": "id string, Id string, source string, entity_category string, display_name string, DisplayName string, type "
                  "string, email string, PrimaryEmailAddr struct<Address:string>, phone string, currency string, balance double, "
                  "address struct<line1:string,city:string,state:string,postal_code:string>, department string, hourly_rate "
                  "double, created_at string, last_modified string",
    "psa": f"id string, Id string, source string, entity_category string, slug string, display_name string, DisplayName string, "
           f"type string, created_at string, last_activity string, projects {PROJECTS}, tags array<string>, email string, "
           f"department string, hourly_rate double",
}


def read_json(spark: SparkSession, path: str, system: str, schema: str | None = None) -> DataFrame:
    """The records of a JSON array, with a fixed schema; a broken file is an error, not a row of nulls.

    Keys that differ by case alone (id and Id) are two keys, so each record is read as a variant and its fields are taken by
    path; a field of another kind than the schema's is null."""
    rows = spark.read.option("singleVariantColumn", "v").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(F.explode(F.variant_get("v", "$", "array<variant>")).alias("v"))  # fails if it is no array
    fields = T.StructType.fromDDL(schema or ENTITY_SCHEMA[system]).fields
    names = [f.name for f in fields]
    return rows.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(_plain(f.name, names)) for f in fields])


def _plain(name: str, names: list[str]) -> str:
    """A name that stays its own when case doesn't count."""
    return f"{name}_live" if name != name.lower() and name.lower() in names else name


def _or(*values: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def _have(rows: DataFrame, *names: str) -> list[Column]:
    own = set(rows.columns)
    return [F.col(n) for n in names if n.split(".")[0] in own] or [F.lit(None).cast("string")]


def kind_of(system: str, kind: str) -> str:
    try:
        return KINDS[system][kind.lower()]
    except KeyError:
        raise ValueError(f"unknown kind {kind!r} of {system}") from None


def of_kind(rows: DataFrame, system: str, kind: str) -> DataFrame:
    return rows.where(F.col("type") == kind_of(system, kind))


def matching(rows: DataFrame, system: str, **filters: str) -> DataFrame:
    """Rows that meet all of display_name_contains, email_contains (whatever the case) and, for psa, department; other filters are ignored."""
    holds = lambda of, text: F.contains(F.lower(F.coalesce(_or(*of), F.lit(""))), F.lit(text.lower()))
    if text := filters.get("display_name_contains"):
        rows = rows.where(holds(_have(rows, "display_name", "DisplayName"), text))
    if text := filters.get("email_contains"):
        rows = rows.where(holds(_have(rows, "email", "PrimaryEmailAddr.Address"), text))
    if system == "psa" and "department" in filters:
        rows = rows.where(F.col("department") == filters["department"])
    return rows


def entities(rows: DataFrame, system: str) -> DataFrame:
    """Common entity rows, normalized: source_id, source, category, entity_category, display_name, email, raw_record (JSON) and the rest of normalize()."""
    category = F.coalesce(*_have(rows, "entity_category"), F.when(F.col("type") == PEOPLE[system], "person").otherwise("organization"))
    own = rows.select(
        F.coalesce(_or(*_have(rows, "id", "Id_live", "Id")), F.lit("")).alias("source_id"),
        F.lit(SOURCES[system]).alias("source"),
        F.coalesce(F.nullif(category, F.lit("")), F.when(F.col("type") == PEOPLE[system], "person").otherwise("organization"))
            .alias("entity_category"),
        F.coalesce(_or(*_have(rows, "display_name", "DisplayName")), F.lit("")).alias("display_name"),
        _or(*_have(rows, "email", "PrimaryEmailAddr.Address")).alias("email"),
        F.to_json(F.struct(*rows.columns)).alias("raw_record"),
    )
    return normalize(own)


def transactions(invoices: DataFrame, payments: DataFrame, bills: DataFrame, start: str, end: str) -> DataFrame:
    """source_id, txn_type, amount, currency, txn_date, counterparty, counterparty_kind of the three kinds,
    from start to end, both included.

    Inputs: id, amount, currency, txn_date (ISO text, a date or a time), customer, vendor. The date range is a plain predicate on each
    scan, of the column's own kind, so that it reaches the files; text comes of it afterwards."""
    out = None
    for kind, rows in zip(TRANSACTIONS, (invoices, payments, bills)):
        party = F.col("vendor") if kind == "Bill" else F.col("customer")
        own = rows.where(within(rows, "txn_date", start, end)).withColumn("txn_date", iso_day("txn_date")).select(
            F.col("id").cast("string").alias("source_id"), F.lit(kind.lower()).alias("txn_type"),
                F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
            F.coalesce(_or(F.col("currency")), F.lit("USD")).alias("currency"), "txn_date",
                party.cast("string").alias("counterparty"), F.lit("vendor" if kind == "Bill" else "customer").alias("counterparty_kind"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def within(rows: DataFrame, column: str, start: str, end: str) -> Column:
    """Whether a column of ISO text, dates or times is from the day `start` to the day `end`, both included."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.col(column).between(start, end)
    day_after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
    return (F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(day_after).cast(kind))


def iso_day(column: str) -> Column:
    """A day as ISO text."""
    return F.coalesce(F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd"), F.col(column).cast("string"))


def time_entries(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Time entries from start to end as transactions: amount is hours by the billing rate, or else the hourly rate."""
    rate = F.coalesce(F.nullif(F.col("billing_rate").cast("double"), F.lit(0.0)), F.col("hourly_rate").cast("double"), F.lit(0.0))
    return rows.where(within(rows, "date", start, end)).withColumn("date", iso_day("date")).select(
        F.col("id").cast("string").alias("source_id"), F.lit("time_entry").alias("txn_type"),
            (F.coalesce(F.col("hours").cast("double"), F.lit(0.0)) * rate).alias("amount"),
        F.coalesce("currency", F.lit("USD")).alias("currency"), F.col("date").alias("txn_date"),
            F.col("resource_id").cast("string").alias("counterparty"), F.lit("resource").alias("counterparty_kind"),
            _or(F.col("project_code")).alias("project_code"),
    )


def by_parent(rows: DataFrame) -> DataFrame:
    """id, projects: flat project rows (client_id, code, name, status, budget_hours, logged_hours, hourly_rate, department) gathered by client.

    A client's projects are few; rows without a client are of no one and are left out."""
    fields = T.StructType.fromDDL(f"p {PROJECTS}")["p"].dataType.elementType.names
    held = F.collect_list(F.struct(*fields)).cast(PROJECTS)
    return rows.where("client_id is not null").groupBy(F.col("client_id").cast("string").alias("id")).agg(held.alias("projects"))


def projects(parents: DataFrame, **filters: str) -> DataFrame:
    """source_id (parent::code), parent_source_id, code, name, status, department, budget_hours, logged_hours,
    hourly_rate: a row for each project.

    filters: status, department (equal), code_prefix (case counts)."""
    rows = parents.select(F.col("id").alias("parent"),
        F.explode(F.coalesce("projects", F.array().cast(PROJECTS))).alias("p")).where("p is not null")
    rows = rows.select(F.concat_ws("::", "parent", F.coalesce("p.code", F.lit(""))).alias("source_id"),
        F.col("parent").alias("parent_source_id"), "p.*")
    for k in ("status", "department"):
        if k in filters:
            rows = rows.where(F.col(k) == filters[k])
    return rows.where(F.startswith("code", F.lit(filters["code_prefix"]))) if filters.get("code_prefix") else rows


def project_records(parents: DataFrame, record_type: str = "project", **filters: str) -> DataFrame:
    """projects() as operational records; the only record type of the PSA system is project, another is a ValueError."""
    if record_type.lower() != "project":
        raise ValueError(f"unsupported record type {record_type!r} of psa")
    rows = projects(parents, **filters)
    held = F.struct("budget_hours", F.col("parent_source_id").alias("client_source_id"), "code", "department", "hourly_rate",
        "logged_hours", "status")
    return rows.select("source_id", F.lit(SOURCES["psa"]).alias("source"), F.lit("psa").alias("category"),
        F.lit("project").alias("record_type"), F.coalesce("name", F.lit("")).alias("name"), "parent_source_id",
        F.to_json(held).alias("attributes"))


def operational(records: DataFrame, record_type: str) -> DataFrame:
    """Accounting classes and items, as JSON texts in `record`, as operational records.

    The parent is ParentRef.value where ParentRef is an object; attributes are all keys but the id and the name; what is no
    JSON object gives no row. No reader of the accounting system yields any yet."""
    v = F.try_parse_json("record")
    rows = records.where(F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))).select(v.alias("v"))
    field = lambda path: F.nullif(F.try_variant_get("v", path, "string"), F.lit(""))
    parent = F.when(F.startswith(F.schema_of_variant(F.try_variant_get("v", "$.ParentRef", "variant")), F.lit("OBJECT")),
        F.try_variant_get("v", "$.ParentRef.value", "string"))
    held = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.isin("Id", "Name", "id", "name"))
    return rows.select(
        F.coalesce(field("$.Id"), field("$.id"), F.lit("")).alias("source_id"), F.lit(SOURCES["accounting"]).alias("source"),
            F.lit("accounting").alias("category"), F.lit(record_type).alias("record_type"),
        F.coalesce(field("$.Name"), field("$.name"), F.lit("")).alias("name"), parent.alias("parent_source_id"),
            F.to_json(held).alias("attributes"),
    )


EXPORT = ("source_id", "source", "category", "entity_category", "raw_name", "normalized_name", "email")


def export_rows(normalized: DataFrame) -> DataFrame:
    """The seven columns of an export, in their order."""
    return normalized.withColumnRenamed("display_name", "raw_name").select(*EXPORT)


def export_csv(normalized: DataFrame, path: str) -> None:
    export_rows(normalized).write.option("header", True).csv(path)


def proposal_issues(proposals: DataFrame, source: str, category: str) -> DataFrame:
    """proposals (target_source, target_category, operation) with issues and is_valid."""
    wrong = [F.when(~F.col("target_source").eqNullSafe(F.lit(source)), F.lit("target_source")),
        F.when(~F.col("target_category").eqNullSafe(F.lit(category)), F.lit("target_category")),
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), F.lit("operation"))]
    issues = F.filter(F.array(*wrong), lambda x: x.isNotNull())
    return proposals.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def shadow_writes(valid: DataFrame) -> DataFrame:
    """What valid proposals would do: nothing is written."""
    return valid.where("is_valid").withColumn("executed", F.lit(False)).withColumn("shadow", F.lit(True)).withColumn("preview",
        F.struct("target_source", "target_category", "operation"))


def rollbacks(writes: DataFrame) -> DataFrame:
    """A shadow write always rolls back, others never."""
    return writes.withColumn("rolled_back", F.coalesce(F.col("shadow"), F.lit(False)))


def throttled(calls: DataFrame, limit: int = 500, seconds: int = 60) -> DataFrame:
    """calls (connector, at) with the number within the last `seconds`, itself included, and whether it is over the limit.

    A connector's calls are many and connectors few: calls are counted by the second first, and these counts are dealt by
    stretches of time, each with the seconds before it that its first calls look back to."""
    at = F.col("at").cast("timestamp").cast("long")
    by_second = calls.groupBy("connector", at.alias("second")).agg(F.count("*").alias("n"))
    stretch = F.floor(F.col("second") / (seconds * STRETCH))
    near = F.floor((F.col("second") + seconds - 1) / (seconds * STRETCH))
    dealt = by_second.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch, near))))
    window = Window.partitionBy("connector", "stretch").orderBy("second").rangeBetween(-seconds + 1, 0)
    counts = dealt.withColumn("recent", F.sum("n").over(window)).where(F.col("stretch") == stretch)
    counts = counts.select(F.col("connector").alias("of"), F.col("second").alias("then"), "recent")
    return calls.join(counts, F.col("connector").eqNullSafe(F.col("of")) & at.eqNullSafe(F.col("then")), "left").drop("of",
        "then").withColumn("over_limit", F.col("recent") > limit)


def expired(until: Column, now: Column) -> Column:
    """Whether a token's end (ISO text) has come; one without an end, or with one that can't be read, hasn't expired."""
    return F.coalesce(F.try_to_timestamp(until) <= now, F.lit(False))


def backoffs(attempts: DataFrame, first: float = 0.5) -> DataFrame:
    """attempts (attempt, from 1 on) with the seconds to wait before the next: doubled each time."""
    return attempts.withColumn("wait", first * F.pow(F.lit(2.0), F.greatest(F.col("attempt"), F.lit(1)) - 1))
