"""Turns from raw dialogue text, and runs of one speaker merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import lexicon as lx
from parley.functions import text as tx


def _pair(speaker: Column, text: Column) -> Column:
    return F.struct(speaker.alias("speaker"), text.alias("text"))


def parsed(raw: Column, mode: str = "lenient") -> Column:
    """array<struct<speaker, text>> of a raw dialogue.

    lenient: any line with a colon, whose right side isn't blank. strict: lines that begin with
    ParticipantA: or ParticipantB:, where an empty turn takes the next line. tolerant: lines that begin
    with a label like Participant A:, in any case, empty turns and blanks at their ends kept.
    """
    if mode == "strict":
        pattern = f"(?mU){lx.STRICT_LINE}"
        who, what = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(i)) for i in (1, 2))
        pairs = F.zip_with(who, what, lambda a, b: _pair(a, tx.strip(b)))
        return F.filter(pairs, lambda t: t["text"] != "")
    lines = F.split(raw, "\n")
    if mode == "tolerant":
        pattern = f"(?iU){lx.TOLERANT_LINE}"
        hits = F.filter(F.split(raw, r"\R|[\x1C-\x1E]"), lambda x: x.rlike(pattern))
        return F.transform(hits, lambda x: _pair(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 0), lambda x: _pair(tx.strip(F.substring_index(x, ":", 1)), tx.strip(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.filter(pairs, lambda t: t["text"] != "")


def merged(rows: DataFrame, conv: str, order: list[str], speaker: str, text: str) -> DataFrame:
    """conv, turn_index, speaker, text: cleaned, empties dropped, then neighbours of one speaker joined."""
    w = Window.partitionBy(conv).orderBy(*order)
    clean = rows.withColumn("__t", tx.clean_markup(F.coalesce(F.col(text), F.lit("")))).filter("__t <> ''")
    new = (~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | F.lag("__t").over(w).isNull()).cast("int")
    runs = clean.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(conv, "__run").agg(F.first(speaker).alias("speaker"), F.array_sort(F.collect_list(F.struct(*order, "__t"))).alias("parts"))
    return joined.select(F.col(conv), (F.col("__run") - 1).cast("long").alias("turn_index"), "speaker", F.array_join(F.transform("parts", lambda p: p["__t"]), " ").alias("text"))


def joined_text(turns: DataFrame, name: str = "text", sep: str = " ", labels: bool = False, max_chars: int = 0) -> DataFrame:
    """conv_id and its turns in order as one text; labels: "speaker: text" each."""
    line = F.concat_ws(": ", "speaker", "text") if labels else F.col("text")
    out = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda t: t["line"]), sep)
    return out.select("conv_id", (F.substring(body, 1, max_chars) if max_chars else body).alias(name))


def previous(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("conv_id").orderBy("turn_index"))


def natural_end(turns: DataFrame, closing: Column, text: str = "text", cap: int | None = None, seeds: int = 2) -> DataFrame:
    """conv_id, n_kept: length with the seeds when generation stops one turn after the first farewell, at a second
    farewell in a row, at an empty turn, or at the cap. Both farewell rules end one turn after the first."""
    flags = turns.select("conv_id", "turn_index", closing.alias("c"), (F.trim(text) == "").alias("e"))
    stop = flags.groupBy("conv_id").agg(
        F.count("*").alias("k"), F.min(F.when(F.col("c"), F.col("turn_index"))).alias("close"), F.min(F.when(F.col("e"), F.col("turn_index"))).alias("empty")
    )
    ends = [F.col("k"), F.coalesce("empty", "k"), F.coalesce(F.col("close") + 2, F.col("k"))] + ([F.lit(cap)] if cap is not None else [])
    return stop.select("conv_id", (F.least(*ends) + seeds).cast("long").alias("n_kept"))
