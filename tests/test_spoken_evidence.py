"""Runs of spoken sentences against an enumeration, and the choice among them against all."""

import re
import time

from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import spoken_evidence as E
from claimstone.functions import values as V
from claimstone.functions.facts import fact_tokens
from claimstone.functions.transcripts import comparable

SAID = [
    "The system shall support LDAP Active. Directory for user login. It must lock accounts after three attempts. Reports are exported nightly.", "", None, "one", "It leans. They lean. Clerks archive closed orders every month. And notify managers. When done. The end",
    "Managers approve refunds above 500 dollars within two days.\nNothing else was said\n\nRefunds need approval. " + "x " * 800 + ". Clerks archive closed orders every month.", "Serial. Number is kept. for every asset. This too.",
]
ASKED = ["The system shall support LDAP Active Directory for user login", "Clerks archive closed orders every month", "Managers approve refunds above 500 dollars", "", "serial number is kept for every asset"]


def goes_on(before, after):
    a, b = re.findall(r"[A-Za-z0-9]+", before.lower()), re.findall(r"[A-Za-z0-9]+", after.lower())
    return bool(re.match(V.GOES_ON, after)) or bool(a and b and (a[-1], b[0]) in V.SPLIT_PHRASES)


def enumerated(text):
    s = [p.strip() for p in re.split(r"(?<=[.!?؟])\s+|\n+", text or "") if p.strip()]
    out = []
    for i in range(len(s)):
        if i and re.match(V.LEANS, s[i]):
            continue
        for j in range(i, min(len(s), i + 4)):
            run = " ".join(s[i : j + 1])
            if len(run) <= 1500 and not (j < len(s) - 1 and goes_on(s[j], s[j + 1])):
                out.append(run)
    return out or s


def test_runs(spark):
    got = {r.i: r.r for r in spark.createDataFrame(list(enumerate(SAID)), "i int, t string").select("i", E.runs(F.col("t")).alias("r")).collect()}
    assert got == {i: enumerated(t) for i, t in enumerate(SAID)}


def test_best_runs_against_all(spark):
    pairs = [(10 * a + s, ASKED[a], SAID[s]) for a in range(len(ASKED)) for s in range(len(SAID))]
    rows = [(p, q, run, k) for p, q, said in pairs for k, run in enumerate(enumerated(said))]
    df = spark.createDataFrame(rows, "p int, q string, run string, k int").withColumn("q", comparable(F.col("q"))).withColumn("h", comparable(F.col("run")))
    support = F.array_max(F.transform(C.all_described(C.quotable(F.col("h"))), lambda x: C.support(C.described(F.col("q")), x)))
    every = {}
    for r in df.select("p", "run", "k", support.alias("score"), fact_tokens(F.col("q")).alias("own"), fact_tokens(F.col("h")).alias("held")).orderBy("p", "k").collect():
        own = set(r.own)
        every.setdefault(r.p, []).append((r.score or 0.0, len(own & set(r.held)) / len(own) if own else 0.0, r.run))
    want = {}
    for p, found in every.items():
        enough = [x for x in found if x[0] >= 0.60 and x[1] >= 0.70]
        best = min(enough, key=lambda x: (len(x[2]), -x[0])) if enough else max(found, key=lambda x: (x[0], x[1], -len(x[2])))
        want[p] = (best[0], best[2])
    got = {r.pair: (r.score, r.quote) for r in E.best_runs(spark.createDataFrame(pairs, "pair int, requirement string, said string")).collect()}
    assert got == want and want[0][1].startswith("The system shall support LDAP Active. Directory")


def test_long_recording(spark):
    """Work grows with a recording's sentences, not with their square, and blocks of runs meet without a seam."""
    said = " ".join(f"Clerk {k} keeps order {k} for {k % 7} days." for k in range(3000)) + " Auditors seal ledgers yearly."
    df = spark.createDataFrame([(0, "auditors seal the ledgers yearly", said)], "pair int, requirement string, said string")
    began = time.time()
    runs = df.select(E.runs(F.col("said")).alias("r")).first().r
    assert time.time() - began < 20 and runs == enumerated(said)
    placed = df.select(F.explode(E.blocks(E.runs(F.col("said")))).alias("b")).select("b.at", "b.runs").orderBy("at").collect()
    assert [r for b in placed for r in b.runs] == runs and all(len(b.runs) <= E.TOGETHER for b in placed)
    assert E.best_runs(df).first().quote == "Auditors seal ledgers yearly."
