"""The metrics as SQL: scalar functions, a table function for raw transcripts, and views.

    register(spark); views(spark, turns)
    spark.sql("SELECT conv_id, sum(n_words(text)) FROM turns GROUP BY conv_id")

Bodies are SQL expressions, so the optimizer puts them into the plan as it does built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.functions import lexicon as lx


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\u0027") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(pattern: str, flags: str = "iU") -> str:
    return f"CAST(regexp_count(text, {_literal(f'(?{flags}){pattern}')}) AS BIGINT)"


def _has(pattern: str, flags: str = "iU") -> str:
    return f"text RLIKE {_literal(f'(?{flags}){pattern}')}"


#: Name, parameters, type and body of each scalar function.
FUNCTIONS = [
    ("n_words", "text STRING", "BIGINT", r"CAST(size(array_remove(split(text, r'(?U)\s+'), '')) AS BIGINT)"),
    *[(f"n_{k}", "text STRING", "BIGINT", _count(p)) for k, p in lx.MARKERS.items()],
    ("marker_rate", "n BIGINT, words BIGINT", "DOUBLE", "100 * n / greatest(words, 1)"),
    ("turn_section", "turn_index BIGINT, n_turns BIGINT", "STRING", "CASE WHEN turn_index < n_turns / 2 THEN 'Earlier' ELSE 'Later' END"),
    ("clean_lower", "text STRING", "STRING", r"regexp_replace(regexp_replace(lower(text), r'(?U)\s+', ' '), '^ | $', '')"),
    ("is_fragment", "text STRING", "BOOLEAN", r"n_words(text) BETWEEN 1 AND 3 AND NOT text RLIKE r'(?U)[.?!]\s*$'"),
    ("is_closing", "text STRING", "BOOLEAN", _has(lx.CLOSING)),
    ("is_leak", "text STRING", "BOOLEAN", _has(lx.LEAK)),
]
#: A raw transcript as rows: each line with a colon, split at the first.
TURNS_OF = r"""
SELECT CAST(row_number() OVER (ORDER BY at) - 1 AS BIGINT) AS turn_index, speaker, said AS text FROM (
  SELECT at, trim(substring_index(line, ':', 1)) AS speaker, trim(substring(line, locate(':', line) + 1)) AS said
  FROM (SELECT posexplode(split(raw, '\n')) AS (at, line)) WHERE line LIKE '%:%') WHERE said <> ''
"""


def register(spark: SparkSession) -> None:
    """Temporary functions of the session; again registering replaces them."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION turns_of(raw STRING) RETURNS TABLE(turn_index BIGINT, speaker STRING, text STRING) RETURN {TURNS_OF}")


def views(spark: SparkSession, turns: DataFrame) -> None:
    """turns; measured turns; and conversations, summed from these."""
    turns.createOrReplaceTempView("turns")
    measured = ", ".join(f"n_{k}(text) AS {k}" for k in lx.MARKERS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW measured_turns AS SELECT *, n_words(text) AS words, {measured} FROM turns")
    sums, rates = (", ".join(f"{f} AS {k}" for k, f in own) for own in ([(k, f"sum({k})") for k in lx.MARKERS], [(k, f"marker_rate({k}, words)") for k in lx.MARKERS]))
    summed = f"SELECT conv_id, condition, count(*) AS n_turns, sum(words) AS words, {sums} FROM measured_turns GROUP BY conv_id, condition"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW conversations AS SELECT conv_id, condition, n_turns, words / n_turns AS words, {rates} FROM ({summed})")
