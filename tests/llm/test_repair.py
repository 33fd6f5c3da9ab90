"""op11: the cheapest repair with the least audit, against trying every repair; odd conversations."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from parley.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(initials, faults):
    """(cost, audit) of the best of all repairs: any turn kept, given a role or deleted, turns inserted anywhere."""
    follows, found = {"": "su", "s": "u", "u": "a", "a": "u"}, []

    def go(k, last, cost, audit, inserted):
        if cost > 2 * len(initials):  # deleting all costs no more
            return
        if k == len(initials) and last in ("", "a"):
            found.append((cost, audit))
        if inserted < 2:
            for to in set(follows[last]) - {"s"}:
                go(k, to, cost + 5, audit + "I", inserted + 1)
        if k < len(initials):
            go(k + 1, last, cost + 2, audit + "D", 0)
            for to in follows[last] if faults[k] not in (repair.BLANK, repair.DUPLICATE) else "":
                own, more = "sua?"[initials[k]] == to, 5 * (faults[k] == repair.CUT)
                if own or to != "s":
                    go(k + 1, to, cost + more + (0 if own else 1), audit + "RK"[own], 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_every_repair():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randint(0, 7)
        initials, faults = ([rng.choice(x) for _ in range(n)] for x in ([0, 1, 1, 2, 2, 3], [0, 0, 0, 0, 1, 2, 3]))
        cost, letters, roles = repair.repair(np.array(initials, np.int8), np.array(faults, np.int8))
        assert (cost, letters.decode()) == every_repair(initials, faults), (initials, faults)
        assert len(letters) == len(roles)


def rows_of(df):
    return {r.conv_id: r for r in df.collect()}


def test_by_hand(spark):
    log = spark.createDataFrame(
        [
            (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"),
            (2, 0, "user", "Hi."), (2, 3, "user", "Still there?"), (2, 3, "user", "Still there?"), (2, 4, "assistant", "Yes."),
            (3, 0, "assistant", " \t\n"), (3, 1, "tool", None),
            (4, None, "user", "One."), (4, 7, "assistant", "and then"), (4, 9, None, "Three?"),
            (None, 1, "user", "Who?"), (None, 2, "user", "Me."),
        ],
        SCHEMA,
    ).withColumn("audit", F.lit(1)).withColumn("k", F.lit("x"))
    got = rows_of(repair.audited(log))
    short = {k: tuple(r)[1:8] for k, r in got.items()}
    # gaps, blank, duplicate, truncated, illegal, cost, audit
    assert short == {
        1: (0, 0, 0, 0, 0, 0, "KKK"), 2: (2, 0, 1, 0, 2, 4, "DKDK"), 3: (0, 2, 0, 0, 1, 4, "DD"), 4: (1, 0, 0, 1, 1, 3, "KDR"), None: (0, 0, 0, 0, 1, 1, "KR"),
    }
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[2].repaired_sha256 == digest("user:Still there?", "assistant:Yes.")
    assert got[3].repaired_sha256 == digest() and got[4].repaired_sha256 == digest("user:One.", "assistant:Three?")
    turns = sorted((tuple(r) for r in repair.repaired(log).filter("conv_id in (2, 4)").collect()), key=repr)
    assert turns == [
        (2, 0, "K", 1, "user", "Still there?"), (2, 1, "K", 3, "assistant", "Yes."), (4, 0, "K", 0, "user", "One."), (4, 1, "R", 2, "assistant", "Three?"),
    ]
    assert repair.audited(log.limit(0)).count() == repair.repaired(log.limit(0)).count() == 0


def test_inserted(spark):
    """Few turns and dear ones: with many good turns around, an insertion may be the cheapest."""
    roles = ["user", "assistant"] * 4 + ["assistant", "user", "assistant"]
    faults = np.zeros(len(roles), np.int8)
    cost, letters, _ = repair.repair(np.array(["sua".index(r[0]) for r in roles], np.int8), faults)
    assert (cost, letters.decode()) == every_repair(["sua".index(r[0]) for r in roles], faults)
    initials = np.array([2, 1] * 3, np.int8)  # begins and ends on the wrong side: two insertions cost 10, all roles 6
    assert repair.repair(initials, np.zeros(6, np.int8))[:2] == (4, bytearray(b"DKKKKD"))


def test_damage(spark, sf_dir):
    """Each kind of damage, and what is left of a conversation whose turns all go."""
    log = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(400) for t in range(1 + c % 2)] + [(None, None, None, None)], SCHEMA)
    hurt = repair.damaged(log)
    assert hurt.filter("present").count() != 601 and hurt.filter("conv_id is null").count() >= 1
    kinds = {(r.role, r.text) for r in hurt.filter("present and conv_id is not null").select("role", "text").distinct().collect()}
    assert kinds == {("assistant", "One. Two!"), ("assistant", ""), ("assistant", "One Two"), ("user", "One. Two!")}
    got = rows_of(repair.audited(hurt, present=F.col("present")))
    assert len(got) == 401
    none = {r.conv_id for r in hurt.groupBy("conv_id").agg(F.max("present").alias("p")).filter("not p").collect()}
    assert none
    for c in none:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation(spark):
    """Streamed in many batches, beside short ones; one text is long."""
    n = 30_001
    turns = spark.range(n).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.col("id").cast("string"), F.when(F.col("id") == 77, F.repeat(F.lit("long "), 400_000)).otherwise(F.lit("")), F.lit(".")).alias("text"),
    )
    other = spark.createDataFrame([(c, t, "user", f"{t}?") for c in (4, 6) for t in range(3)], SCHEMA)
    got = rows_of(repair.audited(turns.union(other)))
    assert (got[5].cost, got[5].audit) == (2, "K" * (n - 1) + "D") and got[4].audit == got[6].audit == "DKR"
    texts = [str(i) + ("long " * 400_000 if i == 77 else "") + "." for i in range(n - 1)]
    lines = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:{t}" for i, t in enumerate(texts))
    assert got[5].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
