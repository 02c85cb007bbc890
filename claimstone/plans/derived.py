"""Requirements, stories, criteria and coverages that Spark derives from orders and their lines.

The given texts hold no requirement language, so rules about it would find nothing in them.
An order's key chooses among wordings, its other columns fill them in; so each rule meets
rows that break it and rows that keep it, and the tables grow with the orders.

A customer is a scope, and ids are those of a scope: its orders are numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.sources.tables import table


def _chosen(key: Column, *choices: Column | str | None) -> Column:
    """The choice that the key, modulo their number, points to."""
    at = F.pmod(key, F.lit(len(choices)))
    out = F.lit(None).cast("string")
    for i, c in enumerate(choices):
        if c is not None:
            out = F.when(at == i, c if isinstance(c, Column) else F.lit(c)).otherwise(out)
    return out


def _few(key: Column, n: int, first: int = 1) -> Column:
    return (F.pmod(key, F.lit(n)) + first).cast("string")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with ``scope`` and ``id``, their number among those of their customer."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").withColumn("scope", F.col("o_custkey")).withColumn("id", number)


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scope, id, text, actor, goal, disposition, labels, candidate_labels, priority, confidence, classification_confidence, needs_review, evidence``."""
    o = orders(spark, sf_dir)
    key, days = F.col("o_orderkey"), _few(F.col("o_orderkey"), 4, 2)
    text = _chosen(
        key, F.concat(F.lit("Only managers may approve refunds above "), (F.floor(F.col("o_totalprice") / 50_000) * 500).cast("string"), F.lit(" dollars.")), F.concat(F.lit("Customers are allowed to return up to "), days, F.lit(" items within 30 days.")),
        "Order records must not be permanently deleted.", "The service shall encrypt payment data and must record each access to payment data.", "Managers approve refunds by order, invoice, and shipment; each refund requires manager approval.",
        "", F.concat(F.lit("The portal shall display the order status within "), days, F.lit(" seconds.")), "Customers may cancel their own open orders.", "Customers may cancel their own open orders and their own open quotes, before shipping.",
        F.concat(F.lit("Business-critical: order search load time stays below "), days, F.lit(" seconds for every customer.")), "It must be", "Customers cannot cancel their own open orders.", "Clerks archive closed orders.",
    )
    quote = F.when(F.pmod(key, F.lit(5)) == 1, F.lit(None).cast("string")).when(F.pmod(key, F.lit(7)) == 3, "Clerks archive closed orders.").otherwise(text)
    evidence = F.filter(F.array(F.struct(F.concat(F.lit("c"), (key % 3).cast("string")).alias("chunk_id"), F.concat(F.lit("d"), (key % 2).cast("string")).alias("document_id"), quote.alias("quote"), F.round((key % 10) / 10.0, 2).alias("support_score"))), lambda e: F.coalesce(e["quote"] != "", F.lit(False)))
    labels = F.when(key % 11 == 0, F.array().cast("array<string>")).when(key % 13 == 1, F.array(F.lit("Out-of-Scope"))).when(key % 13 == 2, F.array(F.lit("Open Question"))).when(key % 3 == 0, F.array(F.lit("FR"), F.lit("NFR"))).otherwise(F.array(F.lit("FR"), F.lit("BR")))
    candidates = F.when(key % 22 == 0, F.array().cast("array<string>")).when(key % 33 == 0, F.array(F.lit("Assumption"))).otherwise(F.array(F.lit("FR")))
    return o.select(
        "scope", "id", text.alias("text"), _chosen(key, "customer", "customers", "manager", None, "order service", "portal").alias("actor"), _chosen(key, "cancel open orders", None, "approve refunds").alias("goal"),
        F.when(key % 19 == 0, "rejected").when(key % 17 == 0, "proposed").otherwise("accepted").alias("disposition"), labels.alias("labels"), candidates.alias("candidate_labels"), _chosen(key, "Medium", "Medium", "High", "Medium", "Critical").alias("priority"),
        F.round((key % 10) / 9.0, 4).alias("confidence"), F.when(key % 23 == 0, 1.5).when(key % 29 == 0, 0.2).otherwise(0.8).alias("classification_confidence"), (key % 6 == 0).alias("needs_review"), evidence.alias("evidence"))


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scope, story, number, criterion_id, text``: a criterion for each line of an order."""
    li = table(spark, sf_dir, "lineitem").join(orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "scope", F.col("id").alias("story")), "l_orderkey")
    key, n = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_linenumber")
    text = _chosen(
        F.col("l_orderkey") + F.floor(n / 2), "Given an open order, when the customer cancels it, then the open order is cancelled by its own customer.", "Given a non-manager, when a refund is asked for, then the approval of the refund is denied.", "The feature works as expected",
        F.concat(F.lit("Then the order status is shown within "), _few(key, 9), F.lit(" seconds.")), "Then the refund request is approved.", "Then the customer cannot cancel their own open orders.", "Then the system must notify the warehouse.",
        "Then closed orders are archived by clerks.", "Then a virus scan is run.", "Then each access to payment data is recorded and payment data is encrypted.",
    )
    return li.select("scope", "story", n.cast("long").alias("number"), F.when(key % 31 == 0, "").otherwise(F.concat(F.lit("ac_"), F.col("l_orderkey").cast("string"), F.lit("_"), n.cast("string"))).alias("criterion_id"), text.alias("text"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scope, id, title, description, source_ids, evidence_reference, points``: a story for each order but every eighth."""
    o = orders(spark, sf_dir).where("o_orderkey % 8 <> 5")
    key, own = F.col("o_orderkey"), F.col("id")
    title = F.when(key % 37 == 0, " ").otherwise(_chosen(key, "Approve refunds", "Return items", "Keep order records", "Encrypt payment data", "Refund approval", "Search orders", "Show the order status", "Cancel open orders"))
    told = _chosen(
        key, "As a manager, I want to approve refunds above a limit, so that refunds stay small.", "As a customer, I want to return items within 30 days, so that returns are easy.", "As the system, I want to keep order records, so that nothing is deleted.",
        "As a clerk, I want payment data to be encrypted, so that each access to payment data is recorded.", "Managers approve refunds.", "As a customer, I want to cancel my own open orders, so that I pay none.", "As a customer, I must not cancel my own open orders, so that none is lost.",
        "As an auditor, I want to delete expired profiles, so that none is left.", "As a manager, I want to approve refunds, so that managers can notify the warehouse.",
    )
    sources = F.when(key % 41 == 0, F.array().cast("array<long>")).when(key % 43 == 0, F.array(F.lit(-1).cast("long"))).when(key % 9 == 0, F.array(own, own + 1)).otherwise(F.array(own))
    return o.select("scope", "id", title.alias("title"), told.alias("description"), sources.alias("source_ids"), F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c1"))).alias("evidence_reference"), _chosen(key, "1", "2", "3", "4", "5", "8").cast("int").alias("points"))


def coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scope, requirement_id, coverage_type, story_ids``."""
    key, own = F.col("o_orderkey"), F.col("id")
    kind = _chosen(key, "covered_by_story", "merged", "covered_by_story")
    return orders(spark, sf_dir).select("scope", F.when(key % 47 == 0, -own).otherwise(own).alias("requirement_id"), kind.alias("coverage_type"), F.array(own).alias("story_ids"))
