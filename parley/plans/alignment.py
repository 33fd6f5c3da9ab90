"""Queries on the alignment of turns, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import alignment, inference
from parley.operators.working import kept
from parley.sources import conversations as src
from parley.sources.conversations import TURNS_SQL, table_turns

DIGITS = 9


def align_ngrams(spark, sf_dir):
    """The n-gram measures of every turn that answers another speaker."""
    rows = alignment.ngram_alignment(table_turns(spark, sf_dir))
    return rows.select("conv_id", "turn_index", *[F.round(m, DIGITS).alias(m) for m in alignment.MEASURES])


def align_measured(spark, sf_dir):
    """Halves of the first turns by condition, from the n-gram measures."""
    rows = src.alignment_sections(alignment.alignment_table(table_turns(spark, sf_dir)))
    means = [F.round(F.avg(c), DIGITS).alias(c) for c in ("syntax_stan", "lexical")]
    return rows.groupBy("condition", "section").agg(F.count("*").alias("n"), *means)


def align_semantic(spark, sf_dir):
    """Meaning by word vectors that are trained on the turns."""
    turns = table_turns(spark, sf_dir)
    return alignment.semantic_alignment(turns, alignment.word_vectors(turns))


def alignment_measured_model(spark, sf_dir):
    """measure ~ condition * section + (1 | conversation) over measured turns, each condition against the human one."""
    turns = table_turns(spark, sf_dir)
    rows = src.alignment_sections(alignment.alignment_table(turns, alignment.word_vectors(turns))).withColumn("later", (F.col("section") == "Later").cast("int"))
    rows = kept(rows.select("condition", "conv_id", "later", "cosine_semanticL", "syntax_stan", "lexical"))
    found = [
        {"measure": dv, **r} for dv in ("cosine_semanticL", "syntax_stan", "lexical")
        for r in inference.mixed_models(rows, dv, "conv_id", "human", ["later"], "condition", src.HUMAN, first=1)
    ]
    return spark.createDataFrame(found, "measure string, condition string, term string, coef double, se double, z double, p double, group_var double, residual_var double")


_LEMMA = """CASE WHEN len(w) > 4 AND regexp_matches(w, 'ies$') THEN left(w, len(w) - 3) || 'y' WHEN len(w) > 4 AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, len(w) - 2)
 WHEN len(w) > 3 AND regexp_matches(w, '[^sui]s$') THEN left(w, len(w) - 1) WHEN len(w) > 5 AND regexp_matches(w, 'ing$') THEN left(w, len(w) - 3) WHEN len(w) > 4 AND regexp_matches(w, 'ed$') THEN left(w, len(w) - 2) ELSE w END"""
_TAG = (
    "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words.split())}) THEN '{name}'" for name, words in alignment.CLASSES.items())
    + " " + " ".join(f"WHEN regexp_matches(w, '{pattern}') THEN '{name}'" for name, pattern in alignment.ENDINGS) + " ELSE 'NN' END"
)
_MEASURED = f"""WITH {TURNS_SQL},
pr AS (SELECT * FROM (SELECT *, lag(text) OVER w AS prev, lag(speaker) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index)) WHERE prev IS NOT NULL AND before IS DISTINCT FROM speaker),
said AS (SELECT conv_id, turn_index, condition, side, list_transform(regexp_extract_all(said, '[a-zA-Z'']+'), lambda w: lower(w)) AS ws
         FROM (SELECT conv_id, turn_index, condition, 'a' AS side, prev AS said FROM pr UNION ALL SELECT conv_id, turn_index, condition, 'b', text FROM pr)),
forms AS (SELECT conv_id, turn_index, side, 'tok' AS kind, ws AS forms, list_transform(ws, lambda w: {_TAG}) AS tags FROM said
          UNION ALL SELECT conv_id, turn_index, side, 'lem', list_transform(ws, lambda w: {_LEMMA}), list_transform(ws, lambda w: {_TAG}) FROM said),
grams AS (SELECT conv_id, turn_index, side, kind || n AS kind, array_to_string(forms[i : i + n - 1], ' ') AS gram, array_to_string(tags[i : i + n - 1], ' ') AS tags
          FROM (SELECT *, unnest(range(1, len(forms) - n + 2)) AS i FROM forms, (VALUES (2), (3)) t(n))),
counts AS (SELECT conv_id, turn_index, kind, gram, tags, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM grams GROUP BY ALL),
lex AS (SELECT conv_id, turn_index, kind, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b) / sqrt(sum(a * a)::DOUBLE * sum(b * b)) END AS v FROM counts GROUP BY ALL),
classes AS (SELECT conv_id, turn_index, kind, tags, sum(a) AS a, sum(b) AS b FROM counts WHERE a = 0 OR b = 0 GROUP BY ALL),
syn AS (SELECT conv_id, turn_index, kind, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b) / sqrt(sum(a * a)::DOUBLE * sum(b * b)) END AS v FROM classes GROUP BY ALL),
measured AS (SELECT pr.conv_id, pr.turn_index, pr.condition, {", ".join(f"max(v) FILTER (m = '{m}') AS {m}" for m in alignment.MEASURES)}
  FROM pr LEFT JOIN (SELECT conv_id, turn_index, 'lexical_' || kind AS m, v FROM lex UNION ALL SELECT conv_id, turn_index, 'syntax_stan_' || kind, v FROM syn) x USING (conv_id, turn_index) GROUP BY ALL)
"""
_MEAN = {f: f"list_avg(list_filter([{', '.join(m for m in alignment.MEASURES if m.startswith(f))}], lambda x: x IS NOT NULL))" for f in ("syntax_stan", "lexical")}

SQL = {
    "align_ngrams": _MEASURED + "SELECT conv_id, turn_index, " + ", ".join(f"round({m}, {DIGITS}) AS {m}" for m in alignment.MEASURES) + " FROM measured",
    "align_measured": _MEASURED + "SELECT condition, CASE WHEN turn_index < 5 THEN 'Earlier' ELSE 'Later' END AS section, count(*)::BIGINT AS n, "
    + ", ".join(f"round(avg({sql}), {DIGITS}) AS {f}" for f, sql in _MEAN.items()) + " FROM measured WHERE turn_index < 10 GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (align_ngrams, align_measured, align_semantic, alignment_measured_model)}
