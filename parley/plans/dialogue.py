"""Queries over dialogue turns: metrics, labels and quality, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import labels, metrics, quality
from parley.operators import turns as tn
from parley.sources.conversations import TURNS_SQL, table_turns


def turn_lengths(spark, sf_dir):
    m = metrics.conversation_metrics(table_turns(spark, sf_dir))
    return m.select("conv_id", "condition", "n_turns", "mean_words", "median_words", "sd_words")


def marker_rates(spark, sf_dir):
    m = metrics.conversation_metrics(table_turns(spark, sf_dir))
    return m.select("conv_id", *[f"{k}_{how}" for k in lx.MARKERS for how in ("per_100", "by_turn")])


def _metric(*columns):
    return lambda spark, sf_dir: metrics.conversation_metrics(table_turns(spark, sf_dir)).select("conv_id", *columns)


def condition_summary(spark, sf_dir):
    return metrics.condition_summary(metrics.conversation_metrics(table_turns(spark, sf_dir)))


def condition_table(spark, sf_dir):
    return metrics.condition_table(table_turns(spark, sf_dir))


def corpus_checks(spark, sf_dir):
    return metrics.corpus_checks(table_turns(spark, sf_dir))


def turn_labels(spark, sf_dir):
    return labels.labelled(table_turns(spark, sf_dir)).select("conv_id", "turn_index", *labels.LABELS.values(), "assistant_like", "social_like")


def topic_codes(spark, sf_dir):
    return labels.labelled(table_turns(spark, sf_dir)).select("conv_id", "turn_index", "topic_code")


def adjacent_overlap(spark, sf_dir):
    return labels.adjacent_overlap(table_turns(spark, sf_dir))


def conversation_tsi(spark, sf_dir):
    return labels.conversation_indices(labels.labelled(table_turns(spark, sf_dir))).drop("architecture", "prompt_level")


def group_tsi(spark, sf_dir):
    return labels.group_indices(labels.conversation_indices(labels.labelled(table_turns(spark, sf_dir))))


def reciprocity(spark, sf_dir):
    return conversation_tsi(spark, sf_dir).select("conv_id", "reciprocity")


def quality_conv(spark, sf_dir):
    return quality.conversation_quality(table_turns(spark, sf_dir))


def quality_verdict(spark, sf_dir):
    return quality.verdicts(quality_conv(spark, sf_dir))


def quality_worst(spark, sf_dir):
    return quality.worst(quality_conv(spark, sf_dir))


def loops(spark, sf_dir):
    """Document lines as turns: where many lines do repeat."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(F.col("doc_id").alias("conv_id"), F.col("source").alias("condition"), F.posexplode(F.split("text", "\n")).alias("turn_index", "text"))
    flags = quality.body_flags(rows.withColumn("condition", F.lit("C1")))
    return flags.filter("loop").select("conv_id", "turn_index")


def drift_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    hits = tx.count(F.col("text"), tx.lx.words(lx.DRIFT_WORDS))
    return d.groupBy("source").agg(F.sum(hits).alias("hits"), F.count_if(hits >= lx.DRIFT_HITS).alias("documents"))


def ab_compare(spark, sf_dir):
    """New: the conversations; old: the same before their last turn was said, so that the shortest have no body."""
    turns = table_turns(spark, sf_dir)
    last = F.max("turn_index").over(Window.partitionBy("conv_id"))
    old = turns.withColumn("last", last).filter("turn_index < last").drop("last")
    return quality.compared(turns, old, spanish=lx.DRIFT_WORDS_TEST, leak=lx.LEAK_TEST, foreign_script=False)


def final_check(spark, sf_dir):
    return quality.final_check(table_turns(spark, sf_dir))


def termination(spark, sf_dir):
    turns = table_turns(spark, sf_dir).filter("turn_index >= 2").withColumn("turn_index", F.col("turn_index") - 2)
    return tn.natural_end(turns, tx.has(F.col("text"), lx.CLOSING), cap=30)


def transcripts(spark, sf_dir):
    return tn.joined_text(table_turns(spark, sf_dir), "transcript", "\n", labels=True)


#: Raw dialogues with malformed lines, and single turns with labels and residue.
RAW = [
    ("1", "ParticipantA: Hi\nparticipantb: Low\nParticipantsA: Stray\nNote: aside\nno colon\nParticipantB: \nParticipantA: Next"),
    ("2", "ParticipantA: Hello!\nParticipantB: Hello!\nParticipantA: a: b"),
    ("3", ""),
]
ONE_TURN = [
    ("1", "ParticipantB: Sure. ParticipantA: And you?"), ("2", "Sounds good."), ("3", "ParticipentB, hello"), ("4", '"Quoted." \nUSER: more'),
    ("5", "ParticipantA: ParticipantB: Twice"), ("6", "Fine. [End of Response] x"), ("7", "```code"), ("8", "ok **Session closed.**"), ("9", "Part of it"), ("10", "A point -> | odd"),
]
MARKUP = [
    (1, "{F Uh, } I think [ I, + I ] know, /"), (2, "<laughter>. /"), (3, "<<long pause>>"), (4, "{D Well, } okay -/"), (5, "# Right. #"),
]


def _raw_logs(spark, sf_dir):
    """The conversations as raw logs, each turn on one line, the user as the one and everyone else as the other participant."""
    label = F.when(F.col("speaker") == "user", "ParticipantA: ").otherwise("ParticipantB: ")
    lines = F.array_sort(F.collect_list(F.struct("turn_index", F.concat(label, F.translate("text", "\n", " ")).alias("line"))))
    return table_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda t: t["line"]), "\n").alias("raw"))


def parse_raw(spark, sf_dir):
    """Malformed dialogues, and the whole table written as raw logs."""
    raw = spark.createDataFrame(RAW, "id string, raw string").union(_raw_logs(spark, sf_dir))
    modes = [raw.select("id", F.lit(m).alias("mode"), F.posexplode(tn.parsed(F.col("raw"), m)).alias("turn_index", "t")) for m in ("lenient", "strict", "tolerant")]
    return modes[0].union(modes[1]).union(modes[2]).select("id", "mode", "turn_index", "t.speaker", "t.text")


def clean_markup(spark, sf_dir):
    """Marked up turns, and all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.createDataFrame(MARKUP, "id long, raw string").union(docs).select("id", tx.clean_markup(F.col("raw")).alias("text"))


def clean_turn(spark, sf_dir):
    """Single turns with labels and residue, and the raw logs of all conversations, of which the first turn is left."""
    first = tx.first_utterance(F.col("raw"))
    return spark.createDataFrame(ONE_TURN, "id string, raw string").union(_raw_logs(spark, sf_dir)).select("id", first["text"].alias("text"), first["ran_past"].alias("ran_past"), tx.strip_residue(F.col("raw")).alias("no_residue"))


def merge_turns(spark, sf_dir):
    """Each user's events in order, neighbours of one type merged."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return tn.merged(e, "user_id", ["ts", "event_id"], "event_type", "text")


# ---- oracles


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '(?i){_q(pattern)}'))"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){_q(pattern)}')"


WITH = "WITH " + TURNS_SQL
IDENTITY = "any_value(CASE WHEN condition = 'SB' THEN 'SB' ELSE 'LLM' END) AS source, any_value(split_part(condition, '-', 1)) AS architecture, any_value(CASE WHEN condition = 'SB' THEN 'SB' ELSE split_part(condition, '-', 2) END) AS prompt_level"
_JOINED = ", joined AS (SELECT conv_id, string_agg(ascii, ' ' ORDER BY turn_index) AS ascii, string_agg(text, ' ' ORDER BY turn_index) AS raw, sum(words) AS words, count(*) AS n FROM turns GROUP BY conv_id)\n"
_LOGS = ", lines AS (SELECT conv_id, turn_index, CASE WHEN speaker = 'user' THEN 'ParticipantA' ELSE 'ParticipantB' END AS who, replace(text, chr(10), ' ') AS text FROM turns), logs AS (SELECT conv_id AS id, string_agg(who || ': ' || text, chr(10) ORDER BY turn_index) AS raw FROM lines GROUP BY 1)\n"
_FIRST = f"""
, peeled AS (SELECT id, raw, regexp_replace(trim(raw), '(?i)^(?:\\s*{_q(lx.LEAD_LABEL)})+', '') AS p FROM logs)
, logged AS (SELECT id, regexp_replace(trim(regexp_replace(p, '(?is)(?:{_q(lx.INNER_LABEL)}).*', ''), e' \\n'), '^"+|"+$', '', 'g') AS text, regexp_matches(p, '(?i){_q(lx.INNER_LABEL)}') AS ran_past,
  trim(regexp_replace(trim(regexp_replace(raw, '(?ims)(?:{_q(lx.RESIDUE)}).*', ''), e' \\n'), '^"+|"+$', '', 'g'), e' \\n') AS no_residue FROM peeled)
"""
_PHRASES = " + ".join(f"(length({{t}}) - length(replace({{t}}, '{_q(p)}', ''))) // {len(p)}" for p in lx.SYCOPHANCY_PHRASES)
_LABEL_SQL = f"""
, low AS (SELECT *, trim(regexp_replace(lower(ascii), '\\s+', ' ', 'g')) AS l, lag(text) OVER (PARTITION BY conv_id ORDER BY turn_index) AS prev FROM turns)
, f AS (SELECT *, ({_has('l', lx.any_of(lx.TASK))})::INT AS a,
  ({_has('l', lx.any_of(lx.EXPLANATION))} OR words >= 45 AND {_has('l', lx.EXPLANATION_LONG)})::INT AS h, ({_has('l', lx.any_of(lx.REPAIR))})::INT AS g,
  ({_has('l', lx.any_of(lx.BACKCHANNEL))} OR words <= 4 AND {_has('l', lx.BACKCHANNEL_SHORT)})::INT AS d,
  ({_has('l', lx.any_of(lx.PERSONAL))})::INT AS e, ({_has('l', lx.any_of(lx.PHATIC))})::INT AS c FROM low)
, lab AS (SELECT *, ((contains(text, '?') OR {_has('l', lx.any_of(lx.RECIPROCAL))} OR c = 1 OR e = 1) AND h = 0)::INT AS b FROM f)
, tok AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS cur, list_distinct(regexp_extract_all(lower(coalesce(prev, '')), '[a-z'']+')) AS pre FROM lab)
, lx AS (SELECT *, greatest(a, h) AS assistant_like, greatest(b, c, e, g) AS social_like,
  CASE WHEN prev IS NULL OR prev = '' THEN 'F1_maintain' WHEN len(cur) = 0 THEN 'F4_loop'
       WHEN trim(regexp_replace(lower(prev), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) THEN 'F4_loop'
       WHEN len(list_intersect(pre, cur)) / len(cur) >= 0.22 THEN 'F1_maintain' WHEN len(list_intersect(pre, cur)) / len(cur) >= 0.07 THEN 'F2_smooth_shift' ELSE 'F3_abrupt_drift' END AS topic_code FROM tok)
"""
_TSI_SQL = _LABEL_SQL + """
, sp AS (SELECT conv_id, speaker, avg(social_like) AS s FROM lx GROUP BY ALL), rc AS (SELECT conv_id, CASE WHEN count(*) >= 2 THEN greatest(0.0::DOUBLE, 1 - (max(s) - min(s))) END AS reciprocity FROM sp GROUP BY 1)
, cv AS (SELECT conv_id, condition, count(*)::BIGINT AS n_turns, avg(a) AS "rate_A", avg(b) AS "rate_B", avg(c) AS "rate_C", avg(d) AS "rate_D", avg(e) AS "rate_E", avg(g) AS "rate_G", avg(h) AS "rate_H",
  avg(CASE WHEN topic_code IN ('F1_maintain', 'F2_smooth_shift') THEN 1 ELSE -1 END) AS topic_health FROM lx GROUP BY ALL)
, ix AS (SELECT cv.*, reciprocity, least(1.0::DOUBLE, "rate_A" + "rate_H") AS "ADI", "rate_B" + "rate_C" + "rate_E" + "rate_G" + 0.5::DOUBLE * "rate_D" AS social_rate FROM cv JOIN rc USING (conv_id))
, tsi AS (SELECT *, 100 * (0.35::DOUBLE * least(1.0::DOUBLE, social_rate) + 0.2::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (topic_health + 1) / 2)) + 0.2::DOUBLE * coalesce(reciprocity, 0.5::DOUBLE) + 0.25::DOUBLE * (1 - "ADI")) AS "TSI_proxy" FROM ix)
"""
_SPAN = "len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in lx.DRIFT_WORDS) + ")))"
_SPAN_TEST = _SPAN.split(" IN (")[0] + " IN (" + ", ".join(f"'{w}'" for w in lx.DRIFT_WORDS_TEST) + ")))"


def _quality_sql(name: str, drift: str, leak: str, source: str = "turns", n: str = "count(*)::BIGINT") -> str:
    return f"""
, {name}_b AS (SELECT *, turn_index >= CASE WHEN condition LIKE 'C1%' THEN 0 ELSE 2 END AS body, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS norm FROM {source})
, {name}_f AS (SELECT *, words BETWEEN 1 AND 3 AND NOT regexp_matches(text, '[.?!]\\s*$') AS fragment,
  row_number() OVER (PARTITION BY conv_id, body, norm ORDER BY turn_index) > 1 AND length(norm) > 12 AS loop,
  {drift} AS drift, {_has('ascii', leak)} AS leak, {_has('ascii', lx.TELLS)} AS tell, {_has('ascii', lx.CLOSING)} AS closing FROM {name}_b)
, {name} AS (SELECT conv_id, condition, {n} AS n_turns, median(words) FILTER (body) AS median_words, count(*) FILTER (body AND fragment)::BIGINT AS fragments, count(*) FILTER (body AND loop)::BIGINT AS loops,
  count(*) FILTER (body AND drift)::BIGINT AS drift, count(*) FILTER (body AND leak)::BIGINT AS leaks, count(*) FILTER (body AND tell)::BIGINT AS tells,
  arg_max(closing, turn_index) FILTER (body) AS closed_naturally FROM {name}_f GROUP BY ALL HAVING count(*) FILTER (body) > 0)
"""


_FOREIGN = f"regexp_matches(regexp_replace(text, '[{tx.latin_class()}]', '', 'g'), '\\p{{L}}')"
_BODY_N = "count(*) FILTER (body)::BIGINT"
_SPAN_FINAL = _SPAN.split(" IN (")[0] + " IN (" + ", ".join(f"'{w}'" for w in lx.DRIFT_WORDS_FINAL) + ")))"
_QUALITY = _quality_sql("q", f"({_SPAN} >= 4 OR {_FOREIGN})", lx.LEAK)
_VERDICT = """, v AS (SELECT condition, count(*)::BIGINT AS n, avg(n_turns) AS mean_turns, avg(median_words) AS mean_median_words, sum(fragments)::BIGINT AS fragments, sum(loops)::BIGINT AS loops, sum(drift)::BIGINT AS drift,
  sum(leaks)::BIGINT AS leaks, sum(tells)::BIGINT AS tells, count(*) FILTER (NOT closed_naturally AND condition NOT LIKE 'C1%')::BIGINT AS no_end FROM q GROUP BY condition)
"""

SQL = {
    "turn_lengths": WITH + "SELECT conv_id, condition, count(*)::BIGINT AS n_turns, avg(words) AS mean_words, median(words) AS median_words, coalesce(stddev_samp(words), 0) AS sd_words FROM turns GROUP BY ALL",
    "marker_rates": WITH + _JOINED + ", s AS (SELECT conv_id, " + ", ".join(f"sum({_count('ascii', p)}) AS {k}" for k, p in lx.MARKERS.items()) + " FROM turns GROUP BY 1) SELECT conv_id, "
    + ", ".join(f"100.0::DOUBLE * {_count('joined.ascii', p)} / greatest(words, 1) AS {k}_per_100, 100.0::DOUBLE * s.{k} / greatest(words, 1) AS {k}_by_turn" for k, p in lx.MARKERS.items()) + " FROM joined JOIN s USING (conv_id)",
    "sycophancy_openers": WITH + "SELECT conv_id, avg((" + _has("ascii", r"^\s*(?:" + "|".join(lx.SYCOPHANCY_OPENERS) + r")\b") + ")::INT) AS opener_share FROM turns GROUP BY 1",
    "short_turns": WITH + "SELECT conv_id, avg((words < 5)::INT) AS short_share FROM turns GROUP BY 1",
    "backchannels": WITH + f", b AS (SELECT conv_id, {_has('ascii', lx.BACKCHANNEL_PRESENCE)} AS p, {_has('ascii', lx.BACKCHANNEL_FULL)} AS f FROM turns) SELECT conv_id, count(*) FILTER (p AND f)::DOUBLE / nullif(count(*) FILTER (p), 0) AS backchannel_ratio FROM b GROUP BY 1",
    "contingent_predecessor": WITH + f", o AS (SELECT conv_id, {_has('ascii', lx.MARKERS['oh'])} AS oh, coalesce(regexp_matches(lag(ascii) OVER (PARTITION BY conv_id ORDER BY turn_index), '\\b[A-Z][a-z]{{2,}}\\b|[0-9]+'), false) AS e FROM turns) SELECT conv_id, count(*) FILTER (oh AND e)::DOUBLE / nullif(count(*) FILTER (oh), 0) AS oh_contingency FROM o GROUP BY 1",
    "sycophancy_phrases": WITH + _JOINED + f", s AS (SELECT conv_id, avg((({_PHRASES.format(t='lower(text[1:80])')}) > 0)::INT) AS sycophancy_share FROM turns GROUP BY 1) SELECT conv_id, sycophancy_share, 100.0::DOUBLE * ({_PHRASES.format(t='lower(ascii)')}) / greatest(words, 1) AS sycophancy_per_100 FROM joined JOIN s USING (conv_id)",
    "info_density": WITH + ", d AS (SELECT conv_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM turns), r AS (SELECT conv_id, len(list_filter(ws, lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in lx.STOP_WORDS) + ")))::DOUBLE / len(ws) AS c FROM d WHERE len(ws) > 0) SELECT conv_id, CASE WHEN avg(c) <> 0 THEN coalesce(stddev_samp(c), 0) / avg(c) END AS density_cv FROM r GROUP BY 1",
    "closing_order": WITH + ", t AS (SELECT conv_id, lower(string_agg(ascii, ' ' ORDER BY turn_index) FILTER (back <= 6)) AS tail, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) AS back FROM turns) GROUP BY 1), p AS (SELECT conv_id, n, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(tail, '{_q(p)}') THEN length(regexp_replace(tail, '(?s)(?:{_q(p)}).*', '')) END" for p in lx.CLOSING_STAGES)
    + "], lambda x: x IS NOT NULL) AS pl FROM t) SELECT conv_id, CASE WHEN n >= 4 AND len(pl) >= 2 THEN (pl = list_sort(pl))::INT::DOUBLE END AS closing_order FROM p",
    "condition_table": WITH + _JOINED + ", p AS (SELECT condition, avg(words) AS words_per_turn, count(*)::BIGINT AS turns, count(DISTINCT conv_id)::BIGINT AS conversations FROM turns GROUP BY 1), c AS (SELECT DISTINCT conv_id, condition FROM turns), r AS (SELECT condition, " + ", ".join(f"avg(100.0::DOUBLE * {_count('ascii', p)} / greatest(words, 1)) AS {k}_per_100" for k, p in lx.MARKERS.items()) + " FROM joined JOIN c USING (conv_id) GROUP BY 1) SELECT * FROM p JOIN r USING (condition)",
    "corpus_checks": WITH + "SELECT count(DISTINCT conv_id)::BIGINT AS conversations, count(*)::DOUBLE / count(DISTINCT conv_id) AS mean_turns, avg(words) AS mean_words, median(words) AS median_words FROM turns",
    "turn_labels": WITH + _LABEL_SQL + "SELECT conv_id, turn_index, " + ", ".join(f'{k.lower()} AS "{v}"' for k, v in labels.LABELS.items()) + ", assistant_like, social_like FROM lx",
    "topic_codes": WITH + _LABEL_SQL + "SELECT conv_id, turn_index, topic_code FROM lx",
    "adjacent_overlap": WITH + _LABEL_SQL + "SELECT conv_id, turn_index, len(list_intersect(pre, cur)) / nullif(len(list_distinct(list_concat(pre, cur))), 0) AS overlap FROM tok WHERE prev IS NOT NULL",
    "conversation_tsi": WITH + _TSI_SQL + "SELECT * FROM tsi",
    "reciprocity": WITH + _TSI_SQL + "SELECT conv_id, reciprocity FROM tsi",
    "group_tsi": WITH + _TSI_SQL + "SELECT condition, " + IDENTITY + ", count(*)::BIGINT AS n_conversations, " + ", ".join(f'avg("{k}") AS "mean_{k}"' for k in labels.GROUPED if k != "CAS") + " FROM tsi GROUP BY condition",
    "quality_conv": WITH + _QUALITY + "SELECT * FROM q",
    "quality_verdict": WITH + _QUALITY + _VERDICT + "SELECT *, fragments + loops + drift + leaks + no_end AS bad, CASE WHEN fragments + loops + drift + leaks + no_end = 0 THEN 'PASS' WHEN fragments + loops + drift + leaks + no_end <= n THEN 'FLAG' ELSE 'BAD' END AS verdict FROM v",
    "quality_worst": WITH + _QUALITY + ", w AS (SELECT condition, conv_id, fragments + loops + drift + leaks AS score FROM q WHERE fragments + loops + drift + leaks > 0), k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY score DESC, conv_id)::INT AS rank FROM w) SELECT condition, rank, conv_id, score FROM k WHERE rank <= 3",
    "ab_compare": WITH + ", before AS (SELECT * EXCLUDE back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) AS back FROM turns) WHERE back > 1)" + _quality_sql("q", f"{_SPAN_TEST} >= 4", lx.LEAK_TEST, n=_BODY_N) + _quality_sql("o", f"{_SPAN_TEST} >= 4", lx.LEAK_TEST, "before", _BODY_N) + "SELECT q.conv_id, " + ", ".join(f"{x}.{c}::DOUBLE AS {c}_{tag}" for x, tag in (("q", "new"), ("o", "old")) for c in ("n_turns", "median_words", "leaks", "drift", "loops")) + " FROM q LEFT JOIN o ON q.conv_id = o.conv_id",
    "final_check": WITH + _quality_sql("q", f"{_SPAN_FINAL} >= 4", lx.LEAK, n=_BODY_N) + "SELECT conv_id, condition, n_turns + 2 AS n, median_words, loops, drift AS spanish, leaks, fragments, n_turns + 2 < 32 AS ended_early FROM q",
    "loops": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), n AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')) AS k FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS m FROM n) SELECT doc_id AS conv_id, i::INT AS turn_index FROM r WHERE m > 1 AND length(k) > 12",
    "drift_lines": f"WITH h AS (SELECT source, {_SPAN} AS hits FROM documents) SELECT source, sum(hits)::BIGINT AS hits, count(*) FILTER (hits >= 4)::BIGINT AS documents FROM h GROUP BY source",
    "termination": WITH + f", b AS (SELECT conv_id, turn_index - 2 AS i, {_has('ascii', lx.CLOSING)} AS c, trim(text) = '' AS e FROM turns WHERE turn_index >= 2) SELECT conv_id, (2 + least(count(*), coalesce(min(i) FILTER (e), count(*)), coalesce(min(i) FILTER (c) + 2, count(*)), 30))::BIGINT AS n_kept FROM b GROUP BY 1",
    "transcripts": WITH + "SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_index) AS transcript FROM turns GROUP BY 1",
    "clean_markup": r"SELECT doc_id AS id, regexp_replace(trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '<+[^>]*>+', ' ', 'g'), '\{[A-Z]\s', ' ', 'g'), '}[]+#', '     '), '-?/', ' ', 'g'), '\s+', ' ', 'g')), '\s+([,.?!])', '\1', 'g') AS text FROM documents UNION ALL SELECT * FROM (VALUES (1::BIGINT, 'Uh, I think I, I know,'), (2, '.'), (3, ''), (4, 'Well, okay'), (5, 'Right.')) t(id, text)",
    "parse_raw": WITH + _LOGS + "SELECT conv_id AS id, mode, (row_number() OVER (PARTITION BY conv_id, mode ORDER BY turn_index) - 1)::INT AS turn_index, who AS speaker, CASE mode WHEN 'tolerant' THEN ltrim(text) ELSE trim(text) END AS text FROM lines, (VALUES ('lenient'), ('strict'), ('tolerant')) m(mode) WHERE mode = 'tolerant' OR trim(text) <> '' UNION ALL "
    "SELECT id::VARCHAR, mode, i::INT AS turn_index, speaker, text FROM (VALUES (1,'lenient',0,'ParticipantA','Hi'),(1,'lenient',1,'participantb','Low'),(1,'lenient',2,'ParticipantsA','Stray'),(1,'lenient',3,'Note','aside'),(1,'lenient',4,'ParticipantA','Next'),"
    "(1,'tolerant',0,'ParticipantA','Hi'),(1,'tolerant',1,'participantb','Low'),(1,'tolerant',2,'ParticipantsA','Stray'),(1,'tolerant',3,'ParticipantB',''),(1,'tolerant',4,'ParticipantA','Next'),(1,'strict',0,'ParticipantA','Hi'),(1,'strict',1,'ParticipantB','ParticipantA: Next'),"
    "(2,'lenient',0,'ParticipantA','Hello!'),(2,'lenient',1,'ParticipantB','Hello!'),(2,'lenient',2,'ParticipantA','a: b'),(2,'tolerant',0,'ParticipantA','Hello!'),(2,'tolerant',1,'ParticipantB','Hello!'),(2,'tolerant',2,'ParticipantA','a: b'),(2,'strict',0,'ParticipantA','Hello!'),(2,'strict',1,'ParticipantB','Hello!'),(2,'strict',2,'ParticipantA','a: b')) t(id, mode, i, speaker, text)",
    "clean_turn": WITH + _LOGS + _FIRST + "SELECT * FROM logged UNION ALL SELECT id::VARCHAR, text, ran_past, no_residue FROM (VALUES (1, 'Sure.', true, 'ParticipantB: Sure. ParticipantA: And you?'), (2, 'Sounds good.', false, 'Sounds good.'), (3, 'hello', false, 'ParticipentB, hello'), (4, 'Quoted.', true, 'Quoted.'), (5, 'Twice', false, 'ParticipantA: ParticipantB: Twice'), "
    "(6, 'Fine. [End of Response] x', false, 'Fine.'), (7, '```code', false, ''), (8, 'ok **Session closed.**', false, 'ok'), (9, 'Part of it', false, 'Part of it'), (10, 'A point -> | odd', false, 'A point')) t(id, text, ran_past, no_residue)",
    "merge_turns": "WITH n AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n) SELECT user_id, (run - 1)::BIGINT AS turn_index, any_value(event_type) AS speaker, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS text FROM r GROUP BY user_id, run",
}

_REP = r"""
, w AS (SELECT conv_id, regexp_extract_all(raw, '[\p{L}\p{M}\p{N}_]+') AS ws, string_split_regex(raw, '[\p{L}\p{M}\p{N}_]+') AS gaps FROM joined)
, p AS (SELECT conv_id, unnest(range(1, len(ws) + 1)) AS i, ws, gaps FROM w)
, same AS (SELECT conv_id, i, i > 1 AND lower(ws[i]) = lower(ws[i - 1]) AND regexp_full_match(gaps[i], '\s+') AS s FROM p)
, runs AS (SELECT conv_id, count(*) FILTER (s) AS k FROM (SELECT *, count(*) FILTER (NOT s) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM same) GROUP BY conv_id, run)
, reps AS (SELECT conv_id, sum((k + 1) // 2) AS n FROM runs GROUP BY 1)
"""
#: A run of k + 1 equal words holds (k + 1) // 2 non-overlapping pairs.
SQL["self_repair"] = WITH + _JOINED + _REP + f"SELECT conv_id, 100.0::DOUBLE * (coalesce(reps.n, 0) + {_count('ascii', lx.REPAIR_MARKER)}) / greatest(words, 1) AS self_repair FROM joined LEFT JOIN reps USING (conv_id)"

_PARTS = ("turn_lengths", "marker_rates", "sycophancy_openers", "short_turns", "backchannels", "contingent_predecessor", "self_repair", "closing_order", "sycophancy_phrases", "info_density")
_COUNTS = WITH + f"SELECT conv_id, count(*) FILTER ({_has('ascii', lx.BACKCHANNEL_PRESENCE)})::BIGINT AS n_backchannel_turns, count(*) FILTER ({_has('ascii', lx.MARKERS['oh'])})::BIGINT AS n_oh FROM turns GROUP BY 1"
SQL["condition_summary"] = (
    "SELECT condition, count(*)::BIGINT AS n, " + ", ".join(f"avg({k}) AS {k}_mean, CASE WHEN count({k}) > 0 THEN coalesce(stddev_samp({k}), 0) END AS {k}_sd" for k in metrics.SUMMARISED)
    + f" FROM ({SQL[_PARTS[0]]}) " + " ".join(f"JOIN ({sql}) USING (conv_id)" for sql in (*(SQL[p] for p in _PARTS[1:]), _COUNTS)) + " GROUP BY condition"
)

QUERIES = {
    f.__name__: f
    for f in (
        turn_lengths, marker_rates, condition_summary, condition_table, corpus_checks, turn_labels, topic_codes, adjacent_overlap, conversation_tsi, group_tsi, reciprocity,
        quality_conv, quality_verdict, quality_worst, loops, drift_lines, ab_compare, final_check, termination, transcripts, parse_raw, clean_markup, clean_turn, merge_turns,
    )
} | {
    "sycophancy_openers": _metric("opener_share"), "short_turns": _metric("short_share"), "backchannels": _metric("backchannel_ratio"), "contingent_predecessor": _metric("oh_contingency"),
    "self_repair": _metric("self_repair"), "closing_order": _metric("closing_order"), "sycophancy_phrases": _metric("sycophancy_per_100", "sycophancy_share"), "info_density": _metric("density_cv"),
}
