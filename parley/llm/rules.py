"""Quality rules, line first: failing lines leave, then documents that lost too much text leave.

Only DataFrame functions are used. A document is one row; every step works inside the row, so there
is no shuffle and no key that could be hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: A line of fewer words than this has to end like a sentence.
SHORT_LINE_WORDS = 10
SENTENCE_END = r"""[.!?…:;"'”’»)\]][\x20\x09-\x0D]*$"""
#: Menus, breadcrumbs and symbol runs: words that hold one of these marks.
MARKED_WORD = r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*"
MARKED_SHARE = 0.3
#: Shouting: runs of exclamation marks, one for this share of the words.
SHOUT = r"!!"
SHOUT_SHARE = 0.3
#: Lines about the page, the site or the licence, not the subject: one mention for this share of the words.
BOILERPLATE_SHARE = 0.05
BOILERPLATE = (
    r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe to our|"
    r"sign up for|log ?in to|enable javascript|lorem ipsum|copyright \(c\)|©|licensed under|is licensed|"
    r"public license|apache license|creative commons"
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document goes when less than this share of the characters in its non-blank lines is left.
MIN_KEPT_SHARE = 0.5
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a WINDOW-word run found at least twice.

    Runs are compared by 64-bit hashes. Texts whose runs all differ end at the distinct count; the
    others sort (hash, place) once and measure the union of the repeated runs in one pass.
    """

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        twin = lambda j, k: F.coalesce(F.get(ordered, j)["h"] == F.get(ordered, j + k)["h"], F.lit(False))
        places = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: twin(j, -1) | twin(j, 1)),
            lambda j: F.get(ordered, j)["i"],
        )
        return F.aggregate(
            F.array_sort(places),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    def count(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(pairs, covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), runs), count)


def line_passes(line: Column) -> Column:
    """The line rules: sentence ends on short lines, marks (navigation), shouting, boilerplate. The last three are by
    share of the words, so that a long line isn't lost for one mention."""

    def by_size(n: Column) -> Column:
        return (
            ((n >= SHORT_LINE_WORDS) | line.rlike(SENTENCE_END))
            & (F.regexp_count(line, F.lit(MARKED_WORD)) < F.greatest(F.lit(1), n * MARKED_SHARE))
            & (F.regexp_count(line, F.lit(SHOUT)) < F.greatest(F.lit(1), n * SHOUT_SHARE))
            & (~line.rlike(BOILERPLATE) | (F.regexp_count(line, F.lit(BOILERPLATE)) < n * BOILERPLATE_SHARE))
        )

    return let(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), by_size)


def quality(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs, and after them the measures, the verdict and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept, kept_share,
    base_failed, kept and clean_text, each with prefix before its name; columns of docs by those names
    are replaced. A null text counts as empty: it has no words, so it fails. Blank lines are neither
    kept nor lost; a text whose lines are all blank fails. Repeated rows each get their verdict. A line
    equal to an earlier line of its text is a failed line. An empty table gives an empty table.
    """
    name = lambda c: prefix + c
    body, work = F.coalesce(F.col(text), F.lit("")), "__parley_"
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda xs: F.length(F.array_join(xs, ""))
    words = F.col(work + "words")
    all_lines, kept_lines, distinct = (F.col(work + c) for c in ("lines", "kept_lines", "distinct"))
    out = (
        docs.withColumns({work + "words": words_of(body), work + "lines": lines})
        .withColumns({work + "distinct": F.array_distinct(all_lines)})
        .withColumns({work + "kept_lines": F.filter(distinct, line_passes)})
        .withColumns(
            {
                name("n_words"): F.size(words).cast("long"),
                name("word_chars"): F.length(F.array_join(words, "")).cast("long"),
                name("n_symbols"): F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
                name("n_dup_lines"): (F.size(all_lines) - F.size(distinct)).cast("long"),
                name("n_repeat_words"): repeated_words(words).cast("long"),
                name("n_lines"): F.size(all_lines).cast("long"),
                name("n_lines_kept"): F.size(kept_lines).cast("long"),
                name("kept_share"): F.coalesce(F.try_divide(chars(kept_lines), chars(all_lines)), F.lit(0.0)),
                name("clean_text"): F.array_join(kept_lines, "\n"),
            }
        )
    )
    n, repeats = F.col(name("n_words")), F.col(name("n_repeat_words"))
    out = out.withColumn(name("base_failed"), (n < MIN_WORDS) | (repeats * 100 > n * MAX_REPEAT_PERCENT))
    out = out.withColumn(name("kept"), ~F.col(name("base_failed")) & (F.col(name("kept_share")) >= MIN_KEPT_SHARE))
    return out.drop(*[work + c for c in ("words", "lines", "distinct", "kept_lines")])


def cleaned(docs: DataFrame) -> DataFrame:
    """Kept documents with their failed lines removed, in the columns of docs; n_chars follows the text.

    A null or empty text goes, as it has no words; repeated rows each stay or go; an empty table gives an empty
    table; all other columns, whatever their names, stay as they are.
    """
    names = docs.columns
    out = quality(docs, prefix="__q_").filter(F.col("__q_kept")).withColumn("text", F.col("__q_clean_text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op2_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).drop("text", "clean_text")


#: The same in DuckDB, over words and lines unnested with their places.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, body,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
r AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, list_slice(ws, p, p + 4)) AS n FROM r),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2), (3), (4)) t(k) WHERE n > 1 GROUP BY doc_id),
x AS (SELECT doc_id, u.l, min(u.i) AS at FROM (SELECT doc_id, unnest(list_transform(ls, lambda l, i: {'l': l, 'i': i})) AS u FROM w) GROUP BY ALL),
y AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM x),
z AS (SELECT *, (n >= 10 OR regexp_matches(l, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$'))
        AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*')) < greatest(1, n * 0.3::DOUBLE)
        AND len(regexp_extract_all(l, '!!')) < greatest(1, n * 0.3::DOUBLE)
        AND len(regexp_extract_all(l, '(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe to our|sign up for|log ?in to|enable javascript|lorem ipsum|copyright \(c\)|©|licensed under|is licensed|public license|apache license|creative commons')) < greatest(1, n * 0.05::DOUBLE) AS ok FROM y),
k AS (SELECT doc_id, count(*) AS n_distinct, count(*) FILTER (ok) AS n_lines_kept, coalesce(sum(length(l)) FILTER (ok), 0) AS kept_chars FROM z GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - coalesce(n_distinct, 0))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(n_lines_kept, 0)::BIGINT AS n_lines_kept,
        CASE WHEN len(ls) = 0 THEN 0.0::DOUBLE ELSE kept_chars::DOUBLE / length(array_to_string(ls, '')) END AS kept_share
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_share >= 0.5 AS kept FROM f
"""
