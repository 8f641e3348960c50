"""Stages of the existence match, one case each."""

from pyspark.sql import functions as F

from lexweave.operators import existence as e

KNOWN = [
    (1, "Brown v. Board of Education", ["347 U.S. 483", "74 S. Ct. 686"]),
    (2, "Acme Corporation v. Roe", ["12  F. 3d  99"]),
    (3, None, ["5 F.3d 5"]),
    (4, "Run v. Together", ["77F.2d123"]),
    (5, "Other v. Case", ["12 F.3d 99"]),
    (6, "Smith v. Jones", []),
    (7, "Nobody", None),
]
CITED = [
    # id, case_name, volume, reporter, page, type -> status, stage, case
    ((1, "Brown v. Bd. of Educ.", "347", "U.S.", "483", "case"), (e.VERIFIED, "exact", 1)),
    ((2, "Doe v. Poe", "347", "U.S.", "483", "case"), (e.NAME_MISMATCH, "exact", 1)),
    ((3, None, "74", "S.Ct.", "686", "case"), (e.VERIFIED, "parts", 1)),
    ((4, "Acme Corp. v. Roe", "12", "F.3d", "99", "case"), (e.NAME_MISMATCH, "exact", 5)),  # an equal citation comes before parts
    ((5, "In re Whatever", "5", "F.3d", "5", "case"), (e.VERIFIED, "exact", 3)),  # no name to compare with
    ((6, None, "77", "F.2d", "123", "case"), (e.VERIFIED, "run", 4)),
    ((7, "Run v. Together", "77", "F.2d", "123", "case"), (e.LOCATION_MISMATCH, "name", 4)),  # run together is for nameless ones
    ((8, "Smith v. Jones", "1", "U.S.", "1", "case"), (e.LOCATION_MISMATCH, "name", 6)),
    ((9, "Smith v. Jonas", "1", "U.S.", "1", "case"), (e.NOT_FOUND, "none", None)),
    ((10, "X v. Y", None, "U.S.", "1", "case"), (e.NOT_FOUND, "incomplete", None)),
    ((11, "X v. Y", "1", " ", "1", "case"), (e.NOT_FOUND, "incomplete", None)),
    ((12, "X v. Y", "2020", "WL", "1", "case"), (e.NOT_APPLICABLE, "reporter", None)),
    ((13, None, "42", "U.S.C.", "1983", "statute"), (e.NOT_APPLICABLE, "type", None)),
    ((14, None, "47", "U.S.", "483", "case"), (e.NOT_FOUND, "none", None)),  # not the end of 347
    ((15, None, "347", "U.S.", "48", "case"), (e.NOT_FOUND, "none", None)),
]


def frames(spark):
    known = spark.createDataFrame(KNOWN, "case_id long, case_name string, citations array<string>")
    cited = spark.createDataFrame([c for c, _ in CITED], "id long, case_name string, volume string, reporter string, page string, citation_type string")
    return cited, known


def test_each_stage(spark):
    cited, known = frames(spark)
    got = {r["id"]: (r["status"], r["stage"], r["case_id"]) for r in e.resolve(cited, known, by_name=True).collect()}
    assert got == {c[0]: want for c, want in CITED}
    plain = {r["id"]: r["status"] for r in e.resolve(cited, known).collect()}
    assert all(plain[i] == (e.NOT_FOUND if s == e.LOCATION_MISMATCH else s) for i, (s, _, _) in got.items())


def test_no_nested_loop_and_empty_tables(spark):
    cited, known = frames(spark)
    plan = e.resolve(cited, known, by_name=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["status"] for r in e.resolve(cited, known.limit(0)).collect()} == {e.NOT_FOUND, e.NOT_APPLICABLE}
    assert e.resolve(cited.limit(0), known).collect() == []


def test_no_join_broadcasts_a_table_that_grows(spark, sf):
    from lexweave.plans import entities

    cited, known = frames(spark)
    for df in (e.resolve(cited, known, by_name=True), entities.cite_existence(spark, sf)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_stored_and_flags(spark):
    rows = [(e.VERIFIED, False), (e.NAME_MISMATCH, True), (e.LOCATION_MISMATCH, None), (e.NOT_FOUND, True), (e.NOT_FOUND, None), (e.UNCERTAIN, False), (None, False), ("", True)]
    df = spark.createDataFrame(rows, "s string, f boolean").select(e.stored_status(F.col("s")).alias("stored"), e.flag_kind(F.col("s"), F.col("f")).alias("flag"))
    assert [tuple(r) for r in df.collect()] == [
        (e.VERIFIED, None),
        (e.UNCERTAIN, "name"),
        (e.UNCERTAIN, "location"),
        (e.NOT_FOUND, None),
        (e.NOT_FOUND, "unresolved"),
        (e.UNCERTAIN, "unresolved"),
        (e.NOT_APPLICABLE, None),
        (e.NOT_APPLICABLE, None),
    ]
