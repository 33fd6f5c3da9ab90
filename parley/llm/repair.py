"""Structure of logged conversations: faults are found and the cheapest repair is applied.

A repaired conversation alternates user and assistant turns, begins with a user turn (a system turn may
stand before it) and ends with an assistant turn, or is empty. Turns are kept, given another role or
deleted, and empty turns are inserted.

Faults are DataFrame windows within a conversation. The repair is a dynamic program over retained turns:
which turns stay, and in which role. Between two neighbours that stay, what lies between is
deleted, priced by a prefix sum of deletions, and the pair of roles determines what is inserted. So the cost of all that
follows a retained turn is a minimum over the next one, which a running minimum for each role gives while the
turns are walked through from the last to the first: a few comparisons a turn and role.

Of equally cheap repairs the least audit wins, one letter an edit: D(elete), I(nsert), K(eep), R(erole). Audits
needn't be built to be compared: in a gap all deletions come before all insertions, so the audit whose next
retained turn comes later is less, else that with more insertions, else that which keeps.

A conversation is streamed: its turns come sorted, first as two numbers each, from which the edits are found, then with their
texts, to which they are applied. So a task holds some bytes a turn of one conversation and never
its texts, however long it is. One task sees all of a conversation, as its digest is one hash chain.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.lineage import small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("system", "user", "assistant")
#: Initials as numbers: s, u, a, and any other.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
START = 3
#: What stands between the roles of two neighbours that stay; no key: they can't be neighbours. START: nothing stays before.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: What stands behind the last one that stays.
BEHIND = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
BLANK, DUPLICATE, CUT = 1, 2, 3
_BLANK = r"[^\x20\x09-\x0D]"
INITIALS = "sua"
PAIRS = ("su", "ua", "au")


def repair(initials: np.ndarray, faults: np.ndarray) -> tuple[int, bytearray, bytearray]:
    """Cost and edits of the cheapest repair with the least audit.

    initials: SYSTEM to OTHER of each turn in order; faults: 0, BLANK, DUPLICATE or CUT. Edits are letters, and the roles
    that their turns end up with (of deleted ones it means nothing). Letters other than I take the turns in order.
    """
    initials, faults = initials.tolist(), faults.tolist()
    n, far = len(initials), 1 << 60
    deleted = (DELETE * np.arange(n + 1)).tolist()  # deleted[j]: what it costs to delete the first j turns
    least, which = [far] * 3, [n] * 3  # over later turns k in a role: deletions before k and all from k on; the largest such k
    after, role_after = array("q", [n]) * (3 * n), bytearray(3 * n)  # behind each turn in each role, the next that stays

    def following(role: int, upto: int) -> tuple[int, int, int]:
        """Cost of all behind a turn that stays in role, the next turn that stays, and its role; upto: deletions up to it."""
        best = (deleted[n] + INSERT * len(BEHIND[role]), -n, 0, 0, 0)
        for r in (SYSTEM, USER, ASSISTANT):
            if least[r] < far and (between := BETWEEN.get((role, r))) is not None:
                k = which[r]
                # An audit is less if its next retained turn comes later, else with more insertions, else if it keeps.
                best = min(best, (least[r] + INSERT * len(between), -k, -len(between), initials[k] != r, r))
        return best[0] - upto, -best[1], best[4]

    for j in range(n - 1, -1, -1):
        if faults[j] in (BLANK, DUPLICATE):
            continue
        own, here = initials[j], deleted[j] + (TRUNCATED if faults[j] == CUT else 0)
        priced = []
        for role in (SYSTEM, USER, ASSISTANT):
            if role == own or role != SYSTEM:
                rest, after[3 * j + role], role_after[3 * j + role] = following(role, deleted[j + 1])
                priced.append((role, here + (KEEP if role == own else REROLE) + rest))
        for role, cost in priced:
            if cost < least[role]:  # of equal ones the later turn stays
                least[role], which[role] = cost, j
    cost, k, role = following(START, 0)
    letters, roles, at, before = bytearray(), bytearray(), 0, START
    while True:
        letters += b"D" * (k - at)
        roles += bytes(k - at)
        between = BETWEEN[before, role] if k < n else BEHIND[before]
        letters += b"I" * len(between)
        roles += bytes(between)
        if k >= n:
            return cost, letters, roles
        letters += b"K" if initials[k] == role else b"R"
        roles.append(role)
        at, before = k + 1, role
        k, role = after[3 * k + role], role_after[3 * k + role]


def _faults(log: DataFrame, present: Column, text: str, conv: str, turn: str, role: str) -> DataFrame:
    """conv, k (place from 1), turn, role, text, initial, fault and present of each turn."""
    rows = log.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), present.alias("present"),
    )
    by = Window.partitionBy("conv").orderBy(F.desc("present"), F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv", "present", "role", F.xxhash64("text"), F.xxhash64(F.lit(7), "text")).orderBy("k")
    fault = (
        F.when(~F.col("text").rlike(_BLANK), BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    )
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.length("role") > 0) & (initial >= 0), initial).otherwise(OTHER)
    return rows.withColumn("k", F.row_number().over(by)).withColumns({"fault": fault.cast("byte"), "initial": initial.cast("byte")})


class _Conversation:
    """One conversation as it streams by: numbers first, then texts."""

    def __init__(self, conv):
        self.conv, self.numbers, self.turns, self.letters = conv, [], [], None
        self.at, self.logged, self.place, self.hash = 0, 0, 0, hashlib.sha256()

    def decide(self) -> None:
        codes = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.int8)
        initials, faults = codes & 3, codes >> 2
        self.cost, self.letters, self.roles = repair(initials, faults)
        self.faults = [int(np.count_nonzero(faults == x)) for x in (BLANK, DUPLICATE, CUT)]
        self.illegal = int(np.count_nonzero(~np.isin(initials[:-1] * 4 + initials[1:], [4 * INITIALS.index(a) + INITIALS.index(b) for a, b in PAIRS])))
        known = np.concatenate(self.turns) if self.turns else np.zeros(0, np.int64)
        distinct = 1 + int(np.count_nonzero(known[1:] != known[:-1]))
        self.gaps = min(int(known[-1]) - int(known[0]) + 1 - distinct, (1 << 63) - 1) if len(known) else 0
        self.numbers = self.turns = []

    def apply(self, role: str | None, text: str | None) -> Iterator[tuple]:
        """The repaired turns up to and with the next logged one (None: to the end): conv, place, letter, logged, role, text."""
        while self.at < len(self.letters):
            letter, to = chr(self.letters[self.at]), self.roles[self.at]
            if role is None and letter != "I":
                return
            self.at += 1
            if letter != "D":
                whose, what = (ROLES[to], "") if letter == "I" else (role if letter == "K" else ROLES[to], text)
                self.hash.update(f"{chr(10) if self.place else ''}{whose}:{what}".encode())
                yield self.conv, self.place, letter, None if letter == "I" else self.logged, whose, what
                self.place += 1
            if letter != "I":
                self.logged += 1
                return

    def summary(self) -> tuple:
        return (self.conv, self.gaps, *self.faults, self.illegal, self.cost, self.letters.decode(), self.hash.hexdigest())


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(batches: Iterator[pa.RecordBatch], turns: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conv, texts, turn, code, role, text) in the order of a conversation, numbers (texts false) before texts."""
    now: _Conversation | None = None
    done: list[tuple] = []
    size = 0
    names = ["conv", "place", "edit", "logged", "role", "text"] if turns else ["conv", *_SUMMARY, "audit", "repaired_sha256"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if turns else [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def flushed() -> pa.RecordBatch:
        nonlocal done, size
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        done, size = [], 0
        return out

    def given(conversation: _Conversation, role: str | None, text: str | None) -> None:
        nonlocal size
        for own in conversation.apply(role, text):
            if turns:
                done.append(own)
                size += len(own[5])

    def close(conversation: _Conversation) -> None:
        nonlocal size
        if conversation.letters is None:
            conversation.decide()
        given(conversation, None, None)
        if not turns:
            done.append(conversation.summary())
            size += len(done[-1][7])

    for batch in batches:
        convs, texts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        turn, code = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
        changes = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1] or texts[i] != texts[i - 1]), len(convs)]
        for lo, hi in zip(changes, changes[1:]):
            if lo == hi:
                continue
            if now is None or now.conv != convs[lo]:
                if now is not None:
                    close(now)
                now = _Conversation(convs[lo])
            if not texts[lo]:
                codes = code[lo:hi].astype(np.int8)
                now.numbers.append(codes[codes >= 0])
                own = turn.slice(lo, hi - lo).drop_null()
                now.turns.append(own.to_numpy(zero_copy_only=False).astype(np.int64))
                continue
            if now.letters is None:
                now.decide()
            for role, text in zip(batch.column(4).slice(lo, hi - lo).to_pylist(), batch.column(5).slice(lo, hi - lo)):
                given(now, role, text.as_py())
                if size > 8 << 20:
                    yield flushed()
        if done:
            yield flushed()
    if now is not None:
        close(now)
        if done:
            yield flushed()


def _repaired(log: DataFrame, turns: bool, present: Column, text: str, conv: str, turn: str, role: str) -> DataFrame:
    small_batches(log.sparkSession)
    faults = _faults(log, present, text, conv, turn, role)
    code = F.when(F.col("present"), F.col("initial") + 4 * F.col("fault")).otherwise(-1).cast("byte")
    none = lambda kind: F.lit(None).cast(kind)
    light = F.struct(F.lit(False).alias("texts"), F.when(F.col("present"), F.col("turn")).cast("long").alias("turn"), code.alias("code"), none("string").alias("role"), none("string").alias("text"))
    heavy = F.struct(F.lit(True).alias("texts"), none("long").alias("turn"), F.lit(0).cast("byte").alias("code"), F.col("role"), F.col("text"))
    rows = faults.select("conv", "k", F.explode(F.when(F.col("present"), F.array(light, heavy)).otherwise(F.array(light))).alias("r"))
    rows = rows.select("conv", "k", "r.*").sortWithinPartitions("conv", "texts", "k").drop("k")
    kind = log.schema[conv].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    made = "place long, edit string, logged long, role string, text string" if turns else ", ".join(f"{c} long" for c in _SUMMARY) + ", audit string, repaired_sha256 string"
    arrow = to_arrow_type(kind)
    return rows.mapInArrow(lambda it: _streamed(it, turns, arrow), f"conv {kind.simpleString()}, {made}").withColumnRenamed("conv", conv)


def audited(log: DataFrame, text: str = "text", conv: str = "conv_id", turn: str = "turn", role: str = "role", present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Turns are ordered by turn (null first), then role, then text. A null role or text counts as one blank; turns
    without conv_id are a conversation of their own, with a null conv_id. A repeated row is a duplicate turn. Rows that aren't present only make
    their conversation appear, with zeros, an empty audit and the digest of nothing if it has no other. An empty log gives an empty
    table; other columns are left out.
    """
    return _repaired(log, False, F.lit(True) if present is None else present, text, conv, turn, role)


def repaired(log: DataFrame, text: str = "text", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), logged (place in the log, null
    if inserted), role, text. What audited says of odd rows holds here; a conversation that is deleted has no rows."""
    return _repaired(log, True, F.lit(True), text, conv, turn, role)


def damaged(log: DataFrame) -> DataFrame:
    """conversations with planted faults by a hash of conversation and turn, and whether the row is still there (present)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = log.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (fate != 0).alias("present"), F.when(fate == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__again")


def op11_repair(spark, sf_dir):
    return audited(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present=F.col("present"))


#: The same by a walk over all turns that carries, for each role last put out, the least cost and its least audit.
OP11_SQL = r"""
WITH RECURSIVE
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda ch: [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS fate FROM b),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, range(2) t(i) WHERE fate <> 0 AND (i = 0 OR fate = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
t AS (SELECT *, substr(role, 1, 1) AS r,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
pairs(p, q, n, put) AS (VALUES ('', 's', 0, []), ('', 'u', 0, []), ('', 'a', 1, ['user:']), ('s', 'u', 0, []), ('s', 'a', 1, ['user:']),
                               ('u', 'a', 0, []), ('u', 'u', 1, ['assistant:']), ('a', 'u', 0, []), ('a', 'a', 1, ['user:'])),
ends(p, n, put) AS (VALUES ('', 0, []), ('s', 2, ['user:', 'assistant:']), ('u', 1, ['assistant:']), ('a', 0, [])),
names(q, name) AS (VALUES ('s', 'system'), ('u', 'user'), ('a', 'assistant')),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, ''::VARCHAR AS p, {'cost': 0::BIGINT, 'audit': ''::VARCHAR, 'put': []::VARCHAR[]} AS best FROM t
  UNION ALL
  SELECT conv_id, k, p, min(best) FROM (
    SELECT w.conv_id, t.k, w.p, {'cost': w.best.cost + 2, 'audit': w.best.audit || 'D', 'put': w.best.put} AS best
    FROM walk w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.k = w.k + 1
    UNION ALL
    SELECT w.conv_id, t.k, pairs.q,
           {'cost': w.best.cost + 5 * pairs.n + (CASE WHEN t.r = pairs.q THEN 0 ELSE 1 END) + (CASE WHEN t.fault = 't' THEN 5 ELSE 0 END),
            'audit': w.best.audit || repeat('I', pairs.n) || (CASE WHEN t.r = pairs.q THEN 'K' ELSE 'R' END),
            'put': list_concat(w.best.put, pairs.put, [(CASE WHEN t.r = pairs.q THEN t.role ELSE names.name END) || ':' || t.text])} AS best
    FROM walk w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.k = w.k + 1
    JOIN pairs ON pairs.p = w.p JOIN names ON names.q = pairs.q
    WHERE t.fault NOT IN ('b', 'd') AND (t.r = pairs.q OR pairs.q <> 's'))
  GROUP BY conv_id, k, p),
z AS (SELECT conv_id, min({'cost': best.cost + 5 * ends.n, 'audit': best.audit || repeat('I', ends.n), 'put': list_concat(best.put, ends.put)}) AS best
      FROM walk JOIN ends ON ends.p = walk.p WHERE k = (SELECT max(k) FROM o WHERE o.conv_id IS NOT DISTINCT FROM walk.conv_id) GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM t) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.best.cost, 0)::BIGINT AS cost,
       coalesce(z.best.audit, '') AS audit, sha256(coalesce(array_to_string(z.best.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
