"""Two systems' records and a registry derived from the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.operators.graph import written

SYLLABLES = "bacedifogukalemiponuraseti"


def word(x: str) -> str:
    """Three syllables by the digits of x to the base 13."""
    digit = lambda d: f"substr('{SYLLABLES}', cast(1 + 2 * (cast(floor(({x}) / {d}) as bigint) % 13) as int), 2)"
    return "(" + " || ".join(digit(d) for d in (1, 13, 169)) + ")"


def capital(w: str) -> str:
    return f"(upper(substr({w}, 1, 1)) || substr({w}, 2, 20))"


def first(j: str) -> str:
    return word(f"{j} * 7 + 1")


def second(j: str) -> str:
    return word(f"{j} * 11 + 5")


def kind(j: str) -> str:
    return f"(case ({j}) % 4 when 0 then 'group' when 1 then 'capital' when 2 then 'media' else 'holdings' end)"


def key(x: str) -> str:
    return f"('C' || lpad(cast({x} as string), 8, '0'))"


C = "c_custkey"
CANON = f"""select {key(C)} as canonical_id, 't' || cast({C} % 3 as string) as tenant_id,
  {first(C)} || ' ' || {second(C)} || case when {C} % 5 = 0 then '' else ' ' || {kind(C)} end as canonical_name,
  case when {C} % 5 = 0 then 'person' else 'client' end as entity_type,
  case when {C} % 5 = 0 then 'person' else 'organization' end as entity_category from customer"""
ALIASES = f"""select {key(C)} as canonical_id, {first(C)} || ' ' || {second(C)} as value, 'quickbooks' as source, 'accounting' as category,
  case when {C} % 8 = 0 then null else cast(0.95 as double) end as confidence from customer where {C} % 4 = 0
  union all select {key(C)}, {second(C)} || ' ' || {first(C)}, 'ruddr', 'psa', cast(0.9 as double) from customer where {C} % 6 = 0"""
REFS = f"""select {key(C)} as canonical_id, 'quickbooks' as source, 'accounting' as category, 'QB-' || cast({C} as string) as external_id,
  case when {C} % 10 = 9 then '{{bad' else '{{"email": "P' || cast(({C} % 1000) as string) || '@example.com", "employee_id": "' || cast({C} as string) || '"}}' end as external_fields from customer
  union all select {key(C)}, 'ruddr', 'psa', 'RD-' || cast({C} as string), '{{"role": "principal"}}' from customer where {C} % 3 = 0"""
EDGES = f"""select {key('o_custkey')} as source_node, {key('((o_custkey * 31 + o_orderkey) % 150 + 1)')} as target_node,
  case when o_orderkey % 5 = 0 then 'SAME_AS'
    else 'WORKS_WITH' end as relationship, cast(o_orderkey % 7 as bigint) as approval_count from orders"""
INCOMING = f"""select 'S' || lpad(cast(s_suppkey as string), 8, '0') as entity_id, case when s_suppkey % 2 = 0 then 'QB-'
    else 'RD-' end || cast(j as string) as source_id,
  case when s_suppkey % 2 = 0 then 'quickbooks' else 'ruddr' end as source, case when j % 5 = 0 then 'person'
    else 'organization' end as entity_category,
  case when s_suppkey % 50 = 49 then '   '
    when j % 5 = 0 then case s_suppkey % 8 when 0 then b || ', ' || a when 1 then 'Dr. ' || a || ' ' || b when 2 then a || ' Q. ' || b
      when 3 then replace(a, 'a', 'á') || ' ' || b when 4 then a || ' ' || b || ', Jr.' else a || ' ' || b end
    else case s_suppkey % 8 when 0 then a || ' ' || b || ' ' || k || ', LLC.' when 1 then 'The ' || a || ' ' || b || ' ' || k
    when 2 then b || ' ' || a
      when 3 then replace(a || ' ' || b, 'a', 'á') || ' ' || k when 4 then a || ' & ' || b || ' ' || k || ' Inc'
    when 5 then a || ' ' || b || ' ' || k || ' (Northeast) Corp.'
      when 6 then a || ' ' || b else upper(a || ' ' || b || ' ' || k) end end as display_name,
  case when s_suppkey % 3 = 0 then ' p' || cast(j % 1000 as string) || '@EXAMPLE.com ' end as email, case
    when s_suppkey % 4 = 0 then cast(j as string) end as employee_id,
  '{{"role": "manager"}}' as raw_record
  from (select s_suppkey, j, {capital("w1")} as a, {capital("w2")} as b, {capital(kind("j"))} as k
    from (select s_suppkey, j, {first("j")} as w1, {second("j")} as w2
  from (select s_suppkey, s_suppkey * 13 % 1500 + 1 as j from supplier) as x) as y) as z"""

#: The rules of normalization in RE2, which has no look-ahead: the delimiter is caught and put back, twice.
_HONORIFIC = r"(^|\s)(jr\.?|sr\.?|iii|mr\.?|ms\.?|dr\.?)(\s|$|,|\.)"
_LEGAL = r"(?:,\s*|\s+)(?:limited\s+liability\s+company|l\.l\.c\.?|llc\.?|inc\.?|corp\.?|ltd\.?|llp\.?)(\s|$|\.|,)"
_INVERT = r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$"
_INVERTS = f"entity_category = 'person' and length(display_name) - length(replace(display_name, ',', '')) = 1 and regexp_matches(display_name, '{_INVERT}')"


def _twice(column: str, pattern: str, to: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


_INITIAL = r"\s+[a-z]\.?(\s)"
_SPACES = r"\s+"
NORMALIZED = f"""
  n0 as (select *, case when {_INVERTS} then regexp_replace(display_name, '{_INVERT}', '\\2 \\1') else display_name end as a0
    from incoming),
  n1 as (select *, strip_accents(a0) as a1 from n0), n2 as (select *, lower(a1) as a2
    from n1), n3 as (select *, regexp_replace(a2, '^the\\s+', '') as a3 from n2),
  n4 as (select *, {_twice('a3', _HONORIFIC, r' \\3'.replace(chr(92) * 2, chr(92)))} as a4 from n3),
  n5 as (select *, case when entity_category = 'person' then regexp_replace(a4, '{_INITIAL}', ' \\1', 'g') else a4 end as a5 from n4),
  n6 as (select *, {_twice('a5', _LEGAL, r'\\1'.replace(chr(92) * 2, chr(92)))} as a6 from n5),
  n7 as (select *, regexp_replace(a6, '\\s*\\([^)]*\\)', '', 'g') as a7 from n6), n8 as (select *, replace(a7, '&', ' and ') as a8 from n7),
  n9 as (select *, regexp_replace(a8, '[.,;:!?"''`]', ' ', 'g') as a9 from n8),
  normalized as (select *, trim(regexp_replace(a9, '{_SPACES}', ' ', 'g')) as normalized_name,
    case source when 'quickbooks' then 'accounting' when 'ruddr' then 'psa' else '' end as norm_category from n9)"""
VIEWS = {"canon": CANON, "aliases": ALIASES, "refs": REFS, "edges": EDGES, "incoming": INCOMING}


def ctes(*names: str, normalized: bool = False) -> str:
    """The WITH clause of the named views for an oracle."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + ("," + NORMALIZED if normalized else "")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "supplier") if f"from {t}" in sql}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    # braces of JSON texts are doubled for the formatter, those of tables are not
    for t in tables:
        sql = sql.replace(f"{{{t}}}", f"@@{t}@@")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"@@{t}@@", f"{{{t}}}")
    out = spark.sql(sql, **tables)
    # what is derived is put in place of a stored table: else the optimizer would copy its long expressions into every filter above
    return written(out) if name == "incoming" else out
