"""Queries over events in time, summaries of several grains, nested columns and the SQL surface, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import lexicon as lx
from parley.functions import nested
from parley.functions import sql as surface
from parley.functions import text as tx
from parley.operators import metrics, summaries, temporal
from parley.sources.conversations import TURNS_SQL, table_turns
from parley.streaming import events as stream
from parley.streaming import files

DIGITS = 6
#: Seconds that an as-of match may be old, that a session's rows are apart at most, and of moving frames.
TOLERANCE, GAP = 6 * 3600, "6 hours"
LAST_TURNS, LAST_SECONDS = 5, 24 * 3600
WITH = f"WITH {TURNS_SQL}"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def asof_views(spark, sf_dir):
    """The user's last view before every event of another type, six hours ago at most."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value")
    left, right = e.filter("event_type <> 'view'").drop("value"), e.filter("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    out = temporal.asof(left, right, ["user_id"], "ts", TOLERANCE, "event_id")
    return out.select("event_id", "event_type", "last_event_id", "last_value")


def interval_purchases(spark, sf_dir):
    """Purchases within a span that a signup of the same user opens, value hours long."""
    e = _events(spark, sf_dir)
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("opened"), F.expr("ts + make_dt_interval(0, 0, 0, floor(value * 3600))").alias("ended"))
    points = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("point_id"), F.col("ts").alias("at"))
    return temporal.interval_join(spans, points, ["user_id"], "opened", "ended", "at", 3600).select("user_id", "span_id", "point_id")


def _shown(sessions):
    return sessions.select("user_id", temporal.micros(F.col("start")).alias("start_us"), temporal.micros(F.col("end")).alias("end_us"), "events", F.round("value", DIGITS).alias("value"))


def event_sessions(spark, sf_dir):
    return _shown(temporal.sessions(_events(spark, sf_dir), ["user_id"], "ts", GAP, events=F.count("*"), value=F.sum("value")))


def _stream(spark, sf_dir):
    return stream.event_stream(spark, files.table_files(sf_dir, "events"), "*")


def stream_sessions(spark, sf_dir):
    """The sessions that a stream over the table has closed when all is read."""
    folder = stream.work_folder(spark)
    stream.to_files(stream.closed_sessions(_stream(spark, sf_dir), GAP, "1 hour"), folder)
    return _shown(spark.read.parquet(f"{folder}/rows"))


def stream_followed(spark, sf_dir):
    """Views and the purchases of the user within six hours, joined as two streams."""
    folder = stream.work_folder(spark)
    stream.to_files(stream.followed(_stream(spark, sf_dir), "view", "purchase", GAP, "1 hour"), folder)
    return spark.read.parquet(f"{folder}/rows")


def moving_markers(spark, sf_dir):
    """Marker rates over a turn and the four before, the rank of its length in the conversation, and the third it stands in."""
    rows = metrics.tidy(table_turns(spark, sf_dir))
    frame = temporal.last_rows(["conv_id"], ["turn_index"], LAST_TURNS)
    rate = lambda k: F.round(100 * F.sum(k).over(frame) / F.greatest(F.sum("words").over(frame), F.lit(1)), DIGITS)
    return rows.select(
        "conv_id", "turn_index", *[rate(k).alias(k) for k in lx.MARKERS],
        F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("words"))).alias("length_rank"), F.ntile(3).over(Window.partitionBy("conv_id").orderBy("turn_index")).alias("third"),
    )


def moving_events(spark, sf_dir):
    """Of each event the user's events and mean value of the last day, and the quarter of its value among the user's."""
    frame = temporal.last_seconds(["user_id"], "ts", LAST_SECONDS)
    return _events(spark, sf_dir).select(
        "event_id", F.count("*").over(frame).alias("events"), F.round(F.avg("value").over(frame), DIGITS).alias("mean_value"),
        F.ntile(4).over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("type_rank"),
    )


def condition_grains(spark, sf_dir):
    out = summaries.by_grains(table_turns(spark, sf_dir))
    return out.select(*[F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def vocabulary_sketches(spark, sf_dir):
    """By condition: exact words and lengths beside whether what merged sketches say is within their error."""
    turns = table_turns(spark, sf_dir)
    said = summaries.read(summaries.merged(summaries.sketches(turns), "condition"))
    length = tx.n_words(F.col("text"))
    exact = turns.select("condition", F.explode(tx.tokens(F.col("text"))).alias("w")).groupBy("condition").agg(F.countDistinct("w").alias("words"))
    near = said.join(exact, "condition").select("condition", "words", (F.abs(F.col("vocabulary") - F.col("words")) <= F.greatest(F.col("words") * summaries.HLL_ERROR, F.lit(1))).alias("words_near"), "q50", "q90")
    # A quantile's true rank reaches from the share below it to the share up to it.
    ranked = turns.select("condition", length.alias("n")).join(F.broadcast(near), "condition").groupBy("condition", "words", "words_near").agg(
        F.count("*").alias("turns"), *[F.avg((F.col("n") < F.col(q)).cast("int")).alias(f"{q}_below") for q in ("q50", "q90")], *[F.avg((F.col("n") <= F.col(q)).cast("int")).alias(f"{q}_upto") for q in ("q50", "q90")]
    )
    inside = lambda q, share: (F.col(f"{q}_below") <= share + summaries.KLL_ERROR) & (F.col(f"{q}_upto") >= share - summaries.KLL_ERROR)
    return ranked.select("condition", "words", "words_near", "turns", inside("q50", 0.5).alias("median_near"), inside("q90", 0.9).alias("q90_near"))


def _damaged_props(spark, sf_dir):
    """Every tenth row's JSON is cut short."""
    cut = F.when(F.col("event_id") % 10 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return _events(spark, sf_dir).select("event_id", "event_type", cut.alias("props"))


def props_variant(spark, sf_dir):
    rows = _damaged_props(spark, sf_dir).withColumn("v", nested.variant(F.col("props")))
    k = nested.field(F.col("v"), "$.k", "long")
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("v").isNull()).alias("malformed"), F.sum(k).alias("k"), F.count(nested.field(F.col("v"), "$.none", "string")).alias("none"))


def props_map(spark, sf_dir):
    """Members of the JSON objects, as a map whose k is called key."""
    m = nested.renamed(nested.text_map(F.col("props")), {"k": "key"})
    rows = _damaged_props(spark, sf_dir).select("event_id", F.explode(m).alias("name", "value"))
    return rows.select("event_id", "name", F.col("value").cast("long").alias("value"))


def props_schema(spark, sf_dir):
    return nested.schema_of(_damaged_props(spark, sf_dir).withColumn("v", nested.variant(F.col("props"))), "v")


def sql_conversations(spark, sf_dir):
    surface.register(spark)
    surface.views(spark, table_turns(spark, sf_dir))
    return spark.sql(f"SELECT conv_id, condition, n_turns, round(words, {DIGITS}) AS words, {', '.join(f'round({k}, {DIGITS}) AS {k}' for k in lx.MARKERS)} FROM conversations")


def sql_turns(spark, sf_dir):
    """Transcripts put together and taken apart again by the table function."""
    surface.register(spark)
    surface.views(spark, table_turns(spark, sf_dir).select("conv_id", "condition", "turn_index", F.regexp_replace("text", r"\s+", " ").alias("text"), "speaker"))
    return spark.sql(r"""
        SELECT t.conv_id, p.turn_index, p.speaker, n_words(p.text) AS words, is_fragment(p.text) AS fragment
        FROM (SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn_index, speaker, text))), x -> concat(x.speaker, ': ', x.text)), '\n') AS raw FROM turns GROUP BY conv_id) t, LATERAL turns_of(t.raw) p
    """)


_SESSIONS = """n AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR AS same FROM events),
r AS (SELECT *, count(*) FILTER (same IS DISTINCT FROM true) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n),
s AS (SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events, sum(value) AS value FROM r GROUP BY user_id, run)
"""
_SHOWN = f"SELECT user_id, epoch_us(opened) AS start_us, epoch_us(ended) AS end_us, events, round(value, {DIGITS}) AS value FROM s"
_PROPS = "p AS (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN left(props, len(props) - 1) ELSE props END AS props FROM events), j AS (SELECT *, CASE WHEN json_valid(props) THEN props END AS v FROM p)"
_RATES = ", ".join(f"len(regexp_extract_all(ascii, '(?i){p}'))::BIGINT AS {k}" for k, p in lx.MARKERS.items())
_GRAIN = "CASE " + " ".join(
    f"WHEN {' AND '.join(f'grouping({c}) = {0 if c in g else 1}' for c in summaries.GRAIN)} THEN '{', '.join(c for c in summaries.GRAIN if c in g) or 'all'}'" for g in summaries.GRAINS
) + " END"

SQL = {
    "asof_views": "SELECT l.event_id, l.event_type, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.event_id END AS last_event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.value END AS last_value "
    "FROM (SELECT * FROM events WHERE event_type <> 'view') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "interval_purchases": "SELECT a.user_id, a.event_id AS span_id, b.event_id AS point_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND a.ts <= b.ts AND b.ts < a.ts + to_seconds(floor(a.value * 3600)::BIGINT)",
    "event_sessions": f"WITH {_SESSIONS}" + _SHOWN,
    "stream_sessions": f"WITH {_SESSIONS}" + _SHOWN + " WHERE ended <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "stream_followed": "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.ts <= b.ts AND b.ts < a.ts + INTERVAL 6 HOUR",
    "moving_markers": WITH + f", m AS (SELECT conv_id, turn_index, words, {_RATES} FROM turns) SELECT conv_id, turn_index, "
    + ", ".join(f"round(100.0::DOUBLE * sum({k}) OVER f / greatest(sum(words) OVER f, 1), {DIGITS}) AS {k}" for k in lx.MARKERS)
    + ", dense_rank() OVER (PARTITION BY conv_id ORDER BY words DESC)::INT AS length_rank, ntile(3) OVER (PARTITION BY conv_id ORDER BY turn_index)::INT AS third FROM m WINDOW f AS (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "moving_events": f"SELECT event_id, count(*) OVER f AS events, round(avg(value) OVER f, {DIGITS}) AS mean_value, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::INT AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)::INT AS type_rank "
    "FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)",
    "condition_grains": WITH + f", c AS (SELECT CASE WHEN condition = 'SB' THEN 'SB' ELSE 'LLM' END AS source, architecture, prompt_level, condition, conv_id, count(*) AS n, sum(words) AS w, {', '.join(f'sum({k}) AS {k}' for k in lx.MARKERS)} FROM (SELECT *, {_RATES} FROM turns) GROUP BY ALL) "
    f"SELECT source, architecture, prompt_level, condition, {_GRAIN} AS grain, count(*) AS conversations, sum(n)::BIGINT AS turns, round(sum(w) / sum(n), {DIGITS}) AS words_per_turn, "
    + ", ".join(f"round(avg(100.0::DOUBLE * {k} / greatest(w, 1)), {DIGITS}) AS {k}_rate" for k in lx.MARKERS) + f" FROM c GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(g) + ')' for g in summaries.GRAINS)})",
    "vocabulary_sketches": WITH + ", w AS (SELECT condition, count(DISTINCT word) AS words FROM (SELECT condition, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z'']+'), lambda w: lower(w))) AS word FROM turns) GROUP BY 1) SELECT condition, w.words, true AS words_near, count(*) AS turns, true AS median_near, true AS q90_near FROM turns JOIN w USING (condition) GROUP BY ALL",
    "props_variant": f"WITH {_PROPS} SELECT event_type, count(*) AS events, count(*) FILTER (v IS NULL) AS malformed, sum(json_extract(v, '$.k')::BIGINT)::BIGINT AS k, 0::BIGINT AS none FROM j GROUP BY 1",
    "props_map": f"WITH {_PROPS} SELECT event_id, 'key' AS name, json_extract(v, '$.k')::BIGINT AS value FROM j WHERE v IS NOT NULL",
    "props_schema": "SELECT 'OBJECT<k: BIGINT>' AS schema",
    "sql_conversations": WITH + f", m AS (SELECT *, {_RATES} FROM turns) SELECT conv_id, condition, count(*) AS n_turns, round(avg(words), {DIGITS}) AS words, " + ", ".join(f"round(100.0::DOUBLE * sum({k}) / greatest(sum(words), 1), {DIGITS}) AS {k}" for k in lx.MARKERS) + " FROM m GROUP BY ALL",
    "sql_turns": WITH + ", o AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')) AS said FROM turns) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) - 1 AS turn_index, speaker, words, words BETWEEN 1 AND 3 AND NOT regexp_matches(said, '[.?!]\\s*$') AS fragment FROM o WHERE said <> ''",
}

QUERIES = {
    f.__name__: f
    for f in (
        asof_views, interval_purchases, event_sessions, stream_sessions, stream_followed, moving_markers, moving_events, condition_grains, vocabulary_sketches, props_variant, props_map, props_schema, sql_conversations, sql_turns,
    )
}
