"""Criteria of requirements against their wording, sentence by sentence."""

from pyspark.sql import functions as F

from claimstone.functions import criteria

OUTCOMES = {
    "The system must lock accounts after three attempts.": "the system locks accounts after three attempts", "The portal shall push and fetch files": "the portal pushes and fetches files", "Users must not share codes": "users do not share codes",
    "Order records must not be permanently deleted.": "order records are not permanently deleted", "A report should be exported": "a report is exported", "The clerk will not notify and record": "the clerk does not notify and record",
    "They shall pay": "they pay", "Clerks archive orders": "clerks archive orders", "": "", "The gateway must fix": "the gateway fixes", "The cache shall purge old rows": "the cache purges old rows",
}


def test_outcomes(spark):
    df = spark.createDataFrame([(t,) for t in OUTCOMES], "t string")
    assert {r.t: r.x for r in df.select("t", criteria.outcome(F.col("t")).alias("x")).collect()} == OUTCOMES


def test_criteria(spark):
    rows = [
        (1, "Customers may borrow up to 3 assets at a time.", "customer", "To borrow assets."), (2, "The system must lock accounts; the system must lock accounts.", "System", None), (3, "It", None, ""), (4, None, None, None),
        (5, "Managers can view reports by team, priority, and region.", "manager", "view reports"), (6, "Staff are allowed to hold up to 5 open orders.", None, "."),
    ]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, text string, actor string, goal string").select("i", criteria.criteria_of(F.col("text"), F.col("actor"), F.col("goal")).alias("c")).collect()}
    start = "Given the required preconditions are satisfied, when "
    assert got[1][0] == start + "customer attempts to borrow assets, then customers may borrow up to 3 assets at a time."
    assert got[1][1:] == ["Given customer already has 3 assets, when customer attempts to borrow assets again, then the operation does not proceed because the maximum of 3 has been reached."]
    assert got[2] == [start + "the system attempts to the specified behavior, then the system locks accounts."]
    assert got[3] == got[4] == [start + "the system attempts to the specified behavior, then the linked source requirement is satisfied."]
    assert [c.rsplit("then ", 1)[1] for c in got[5]] == ["managers can view reports by team.", "managers can view reports by priority.", "managers can view reports by and region."]
    assert got[6][1] == "Given the system already has 5 open orders, when the system attempts to perform the operation again, then the operation does not proceed because the maximum of 5 has been reached."
