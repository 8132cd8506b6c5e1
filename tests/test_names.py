import pytest

from samewise.functions.names import normalize, split_rejects

CASES = [
    ("organization", "Cenlar, LLC.", "cenlar"),
    ("organization", "The Foo & Bar Group, Inc", "foo and bar group"),
    ("organization", "Atlas (Northeast) Corp.", "atlas"),
    ("organization", "Foo Limited Liability Company LLC", "foo"),
    ("organization", "Straße Werke", "straße werke"),
    ("person", "Chen, Michael", "michael chen"),
    ("person", "Marcus Williams, Jr.", "marcus williams"),
    ("person", "José Álvarez", "jose alvarez"),
    ("person", "Sarah J. Martinez", "sarah martinez"),
    ("person", "A, B, C", "a b c"),
    ("person", "Ruiz-Fernandez, Ana", "ana ruiz-fernandez"),
    ("organization", "Ångström é", "angstrom e"),
]

#: Names of both systems as they come, and as they must be.
GOLDEN = [
    ("organization", "Cenlar, LLC.", "cenlar"),
    ("organization", "Meridian Capital Group LLC", "meridian capital group"),
    ("organization", "TechVentures Inc", "techventures"),
    ("organization", "Apex Logistics Co.", "apex logistics co"),
    ("organization", "Summit Partners Capital", "summit partners capital"),
    ("organization", "GreenField Analytics, LLC", "greenfield analytics"),
    ("organization", "Northstar Health Systems", "northstar health systems"),
    ("organization", "DataBridge Solutions", "databridge solutions"),
    ("organization", "Vanguard Holdings Inc.", "vanguard holdings"),
    ("organization", "Beck & Howell Consulting Group", "beck and howell consulting group"),
    ("organization", "The Briarwood Group, LLC", "briarwood group"),
    ("organization", "Pinnacle Engineering (Northeast)", "pinnacle engineering"),
    ("organization", "BrightPath Machine Learning Corp", "brightpath machine learning"),
    ("organization", "Hargrove Financial Services, Inc.", "hargrove financial services"),
    ("organization", "Pacific Rim Technologies International", "pacific rim technologies international"),
    ("organization", "Calloway, Reed & Partners LLC", "calloway reed and partners"),
    ("organization", "Ironclad Cybersecurity Solutions LLC", "ironclad cybersecurity solutions"),
    ("organization", "Atlas Communications Corp.", "atlas communications"),
    ("organization", "CloudNine Infrastructure Ltd.", "cloudnine infrastructure"),
    ("person", "Robert Chen", "robert chen"),
    ("person", "Sarah J. Martinez", "sarah martinez"),
    ("person", "Marcus Williams Jr.", "marcus williams"),
    ("person", "Jennifer Park", "jennifer park"),
    ("person", "David Thompson", "david thompson"),
    ("person", "Lisa Hernandez-Garcia", "lisa hernandez-garcia"),
    ("person", "Chen, Michael", "michael chen"),
    ("person", "André Dubois", "andre dubois"),
    ("person", "Wei Chen", "wei chen"),
    ("person", "Tyler R. Johnson", "tyler johnson"),
    ("person", "Amanda Johnson", "amanda johnson"),
    ("person", "Williams, Denise", "denise williams"),
    ("person", "James Whitfield III", "james whitfield"),
    ("person", "Rachel Kim", "rachel kim"),
    ("person", "Carlos Ruiz-Fernandez", "carlos ruiz-fernandez"),
    ("person", "José Álvarez", "jose alvarez"),
    ("person", "Katherine Ellis", "katherine ellis"),
    ("person", "Brian M. Patel", "brian patel"),
    ("person", "Samantha Cruz", "samantha cruz"),
    ("person", "Brooks, Nathan", "nathan brooks"),
    ("person", "William Torres", "william torres"),
    ("person", "Franklin Moore Sr.", "franklin moore"),
    ("person", "Emily Sato", "emily sato"),
    ("person", "Priya Sharma-Gupta", "priya sharma-gupta"),
    ("person", "François Lefèvre", "francois lefevre"),
    ("organization", "Thornton & Marsh LLP", "thornton and marsh"),
    ("organization", "Regency Office Supplies", "regency office supplies"),
    ("organization", "Cenlar FSB", "cenlar fsb"),
    ("organization", "Meridian Capital", "meridian capital"),
    ("organization", "TechVentures", "techventures"),
    ("organization", "Apex Logistics", "apex logistics"),
    ("organization", "Summit Partners", "summit partners"),
    ("organization", "Greenfield Analytics", "greenfield analytics"),
    ("organization", "NorthStar Health", "northstar health"),
    ("organization", "DataBridge", "databridge"),
    ("organization", "Vanguard Digital Labs", "vanguard digital labs"),
    ("organization", "Beck and Howell Consulting", "beck and howell consulting"),
    ("organization", "Briarwood Group", "briarwood group"),
    ("organization", "Pinnacle Engineering", "pinnacle engineering"),
    ("organization", "Luminos AI", "luminos ai"),
    ("organization", "Hargrove Financial", "hargrove financial"),
    ("organization", "PacRim Tech", "pacrim tech"),
    ("organization", "Calloway Reed Partners", "calloway reed partners"),
    ("organization", "Ironclad Security", "ironclad security"),
    ("organization", "Atlas Media Group", "atlas media group"),
    ("organization", "Stratos Cloud", "stratos cloud"),
    ("person", "Bob Chen", "bob chen"),
    ("person", "Sarah Martinez", "sarah martinez"),
    ("person", "Marcus Williams", "marcus williams"),
    ("person", "Jennifer Nakamura", "jennifer nakamura"),
    ("person", "D. Thompson", "d thompson"),
    ("person", "Lisa Garcia", "lisa garcia"),
    ("person", "Michael Chen", "michael chen"),
    ("person", "Andre Dubois", "andre dubois"),
    ("person", "William Chen", "william chen"),
    ("person", "Tyler Johnson", "tyler johnson"),
    ("person", "A. Johnson", "a johnson"),
    ("person", "Denise Williams", "denise williams"),
    ("person", "James Whitfield", "james whitfield"),
    ("person", "Rachel Okonkwo", "rachel okonkwo"),
    ("person", "Carlos Fernandez", "carlos fernandez"),
    ("person", "Jose Alvarez", "jose alvarez"),
    ("person", "Kate Ellis", "kate ellis"),
    ("person", "Brian Patel", "brian patel"),
    ("person", "S. Cruz", "s cruz"),
    ("person", "Nathan Brooks", "nathan brooks"),
    ("person", "Will Torres", "will torres"),
    ("person", "Franklin Moore", "franklin moore"),
    ("person", "Emily Rivera", "emily rivera"),
    ("person", "Priya Gupta", "priya gupta"),
    ("person", "Francois Lefevre", "francois lefevre"),
    ("organization", "Riverstone Capital Advisors", "riverstone capital advisors"),
]


def test_names(spark):
    rows = spark.createDataFrame([(str(i), c, n) for i, (c, n, _) in enumerate(CASES)], "id string, entity_category string, display_name string")
    got = {int(r.id): r.normalized_name for r in normalize(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for *_, w in CASES]


def test_golden_names(spark):
    rows = spark.createDataFrame([(str(i), c, n) for i, (c, n, _) in enumerate(GOLDEN)], "id string, entity_category string, display_name string")
    got = {int(r.id): r.normalized_name for r in normalize(rows).collect()}
    assert len(GOLDEN) == 91 and [got[i] for i in range(91)] == [w for *_, w in GOLDEN]


def test_rejects_and_trace(spark):
    rows = spark.createDataFrame([("a", "organization", "  "), ("b", "person", None), ("c", "organization", "(x)"), ("d", "organization", "The Ok")], "id string, entity_category string, display_name string")
    good, bad = split_rejects(normalize(rows))
    assert {r.id: r.reject_reason for r in bad.collect()} == {"a": "empty or missing display_name", "b": "empty or missing display_name", "c": "name became empty after normalization"}
    assert good.collect()[0].rules_applied == ["lowercase", "strip_the", "collapse_whitespace"]


def test_empty(spark):
    assert normalize(spark.createDataFrame([], "id string, entity_category string, display_name string")).count() == 0
