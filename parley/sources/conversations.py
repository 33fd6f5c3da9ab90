"""Readers: generated dialogue JSON, human-corpus CSV, alignment CSV, and the parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import turns as tn

PERSONA = "struct<label:string,gender:string,age:int,education:string>"
RECORD = (
    "condition string, architecture string, prompt_level string, model string, models map<string,string>, conversation_no long, "
    f"topic string, sb_prompt string, persona_a {PERSONA}, persona_b {PERSONA}, raw_output string, "
    "turns array<array<string>>, n_turns long, multi_turn_emissions long"
)
UTTERANCE = "act_tag string, caller string, utterance_index long, subutterance_index long, text string"
HUMAN = "SB"


def read_records(spark: SparkSession, root: str, conditions: list[str] | None = None, broken: bool = False) -> DataFrame:
    """Every JSON record under root, one schema for all architectures, with its file.

    condition falls back to the file's folder, architecture and prompt_level to the parts of condition;
    a scalar model becomes models["*"]. Files and folders named *.broken* are skipped unless asked for.
    """
    raw = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    file = F.col("_metadata.file_path")
    df = raw.withColumn("file", file)
    if not broken:
        df = df.filter(~F.col("file").contains(".broken"))
    df = with_defaults(df)
    return df.filter(F.col("condition").isin(conditions)) if conditions else df


def with_defaults(records: DataFrame) -> DataFrame:
    """Records (with file) whose missing condition, architecture, prompt level and models are filled in."""
    condition = F.coalesce("condition", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return (
        records.withColumn("condition", condition)
        .withColumn("architecture", F.coalesce("architecture", F.element_at(F.split("condition", "-"), 1)))
        .withColumn("prompt_level", F.coalesce("prompt_level", F.element_at(F.split("condition", "-"), -1)))
        .withColumn("models", F.coalesce("models", F.when(F.col("model").isNotNull(), F.create_map(F.lit("*"), F.col("model")))))
    )


def record_turns(records: DataFrame, mode: str = "lenient", min_turns: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a turn: conv_id, conversation_no, condition, ..., turn_index, speaker, text, after the columns of records
    that keep names (such as file, models, persona_a).

    Listed turns are taken as they are in lenient mode and stripped, without empty ones, in the others; a
    record without them has its raw output parsed. Conversations below min_turns are left out.
    """
    listed = F.transform("turns", lambda t: F.struct(F.get(t, F.lit(0)).alias("speaker"), F.get(t, F.lit(1)).alias("text")))
    if mode != "lenient":
        listed = F.filter(F.transform(listed, lambda t: F.struct(t["speaker"].alias("speaker"), tn.tx.strip(t["text"]).alias("text"))), lambda t: t["text"] != "")
    parsed = F.when(F.size(F.coalesce("turns", F.array())) > 0, listed).otherwise(tn.parsed(F.coalesce("raw_output", F.lit("")), mode))
    kept = records.withColumn("__turns", parsed).filter(F.size("__turns") >= min_turns)
    return kept.select(
        F.concat_ws("/", "condition", F.col("conversation_no").cast("string")).alias("conv_id"),
        "conversation_no", "condition", "architecture", "prompt_level", "topic", *keep, F.posexplode("__turns").alias("turn_index", "__turn"),
    ).select("*", "__turn.speaker", "__turn.text").drop("__turn")


def conversation_no(file: Column) -> Column:
    """sw_0001_4325.utt.csv -> 4325."""
    return F.regexp_extract(file, r"[^/_]+_[^/_]+_(\d+)[^/]*$", 1).try_cast("long")


def read_utterances(spark: SparkSession, root: str) -> DataFrame:
    """Utterance rows of the human corpus with file and conversation_no. Columns are picked by name."""
    options = {"header": True, "recursiveFileLookup": True, "pathGlobFilter": "sw_*.utt.csv", "multiLine": True}
    names = spark.read.options(**options).csv(root)
    file = F.col("_metadata.file_path")
    picked = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in names.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(UTTERANCE)]
    return names.select(*picked, file.alias("file"), conversation_no(file).alias("conversation_no"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a conversation_no, the last in the file where it repeats."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("conversation_no", F.col("conversation_no").try_cast("long")).filter("conversation_no IS NOT NULL")
    fields = [c for c in rows.columns if c not in ("conversation_no", "__at")]
    last = rows.groupBy("conversation_no").agg(F.max_by(F.struct(*fields), "__at").alias("m"))
    return last.select("conversation_no", "m.*")


def first_files(utterances: DataFrame, n: int, metadata: DataFrame | None = None) -> DataFrame:
    """Utterances of the first n files by name: of those with metadata if it is given, else of all."""
    files = utterances.select("file", "conversation_no").distinct()
    if metadata is not None:
        files = files.join(metadata.select("conversation_no"), "conversation_no", "left_semi")
    return utterances.join(F.broadcast(files.orderBy("file").limit(n).select("file")), "file", "left_semi")


def human_turns(utterances: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Human conversations as turns, cleaned, merged by speaker, with topic where metadata has it."""
    merged = tn.merged(utterances, "conversation_no", ["utterance_index", "subutterance_index"], "caller", "text")
    out = merged.withColumns({"condition": F.lit(HUMAN), "architecture": F.lit(HUMAN), "prompt_level": F.lit(HUMAN), "conv_id": F.concat_ws("/", F.lit(HUMAN), F.col("conversation_no").cast("string"))})
    if metadata is None:
        return out.withColumn("topic", F.lit(None).cast("string"))
    return out.join(metadata.select("conversation_no", F.col("topic_description").alias("topic")), "conversation_no")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """The alignment table with numbers where they parse; empty and NaN become null."""
    rows = spark.read.option("header", True).csv(path)
    texts = {"condition", "conv_id"}
    return rows.select(*[F.col(c) if c in texts else tn.tx.to_float(F.col(c)).alias(c) for c in rows.columns])


def alignment_by_conversation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition", "conv_id").agg(F.avg("cosine_semanticL").alias("mean_cosine"), F.count("cosine_semanticL").alias("n"))


def alignment_sections(rows: DataFrame, turns: int = 10) -> DataFrame:
    """The first turns with their half, and each family of sub-measures averaged over those present."""
    mean = lambda names: F.try_divide(
        sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)), sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    )
    families = {f: [f"{f}_{k}" for k in ("tok2", "lem2", "tok3", "lem3")] for f in ("syntax_stan", "lexical")}
    out = rows.filter(F.col("turn_index") < turns).withColumn("section", F.when(F.col("turn_index") < turns / 2, "Earlier").otherwise("Later"))
    return out.withColumns({f: mean(names) for f, names in families.items() if set(names) <= set(rows.columns)})


#: Dialogues in which the English lexicons fire: (condition, number, topic, turns as (speaker, text)).
SAMPLES = [
    ("C2-P1", 9001, "topic1", ["AHello!", "BHello!", "ASo, what do you drive? I mean, which car?", "BI I drive a Honda from 1999.", "AOh, okay. Absolutely, that's a great point.", "BUh-huh.", "AOh really", "BOkay, it was the the best car.", "AWell, I should go. Take care.", "BOkay, have a nice day. Bye!"]),
    ("C3-P1", 9002, "topic1", ["AYou should try to make sure the steps are right.", "BYeah, right.", "AIt is important to remember that many people agree overall.", "BWhat do you mean? I think my mom used to say that.", "ADo you have a car?", "BI feel like in general it is fine."]),
    ("C4-P2", 9003, "topic2", ["AHello!", "BHello!", "AHow can I help you today, sir?", "BI like going to the lake.", "Agood old car", "BI like going to the LAKE!!", "AEl perro de la casa es muy bonito.", "BПривет my friend.", "APartB said hello.", "BYes"]),
    ("C1-P0", 9004, "topic2", ["AI like my dog", "Bmy dog is nice", "AHello  there", "Bhello there", "A...", "Bone two three four five six seven eight nine there", "Axyz uvw rst"]),
    ("SB", 9005, "topic1", ["AUh-huh. okay", "Buh huh, oh I know. What about you?", "AOkay.", "Boh wow, haha, that's funny", "ABye, see you soon!"]),
    ("SB", 9007, "topic1", ["AHi there", "BHi, do you like fishing?", "AI like the lake. My dog likes it too.", "BOh my dog hates the 2 boats."]),
    ("C2-P1", 9008, "topic1", ["AHello!", "BHello!", "AWhich car do you drive?", "BPartner, I drive a truck.", "AA truck? Great question.", "BLa 1ª vez was fun.", "ABye!"]),
    ("C3-P1", 9009, "", ["AHello!", "BHello!", "ANo topic was set for us.", "BSo let us talk about the dog."]),
    ("C3-P1", 9010, "", ["AHello!", "BHello!", "ANo topic again, it seems.", "BThe dog is fine."]),
    ("C2-P1", 9006, "topic2", ["ASo Maria bought 3 cars", "BOh definitely, exactly right", "Aall right then", "BI have to go. Good luck, goodbye"]),
]


def sample_rows() -> list[tuple[str, int, str, int, str, str]]:
    return [(c, no, topic, i, t[0], t[1:]) for c, no, topic, turns in SAMPLES for i, t in enumerate(turns)]


def table_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as turns of derived conditions and topics, with the sample dialogues."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    generated = F.concat(F.lit("C"), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("-P"), (F.floor(F.col("conv_id") / 4) % 3).cast("string"))
    rows = c.select(
        F.when(F.col("conv_id") % 13 == 0, HUMAN).otherwise(generated).alias("condition"), F.col("conv_id").alias("no"),
        F.concat(F.lit("topic"), (F.col("conv_id") % 19).cast("string")).alias("topic"), F.col("turn").cast("long").alias("turn_index"),
        F.col("role").alias("speaker"), "text",
    )
    samples = spark.createDataFrame(sample_rows(), "condition string, no long, topic string, turn_index long, speaker string, text string")
    both = rows.unionByName(samples)
    part = lambda i: F.when(F.col("condition") == HUMAN, HUMAN).otherwise(F.element_at(F.split("condition", "-"), i))
    return both.select(F.concat_ws("/", "condition", F.col("no").cast("string")).alias("conv_id"), "condition", part(1).alias("architecture"), part(-1).alias("prompt_level"), "topic", "turn_index", "speaker", "text")


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


#: DuckDB's view of table_turns; ascii: the text with every other character a letter, as \\b is ASCII there.
TURNS_SQL = f"""samples(condition, no, topic, turn_index, speaker, text) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in sample_rows())}),
base AS (SELECT CASE WHEN conv_id % 13 = 0 THEN 'SB' ELSE 'C' || (conv_id % 4 + 1) || '-P' || ((conv_id // 4) % 3) END AS condition, conv_id AS no,
  'topic' || (conv_id % 19) AS topic, turn AS turn_index, role AS speaker, text FROM conversations UNION ALL SELECT * FROM samples),
turns AS (SELECT condition || '/' || no AS conv_id, condition, CASE WHEN condition = 'SB' THEN 'SB' ELSE split_part(condition, '-', 1) END AS architecture,
  CASE WHEN condition = 'SB' THEN 'SB' ELSE split_part(condition, '-', 2) END AS prompt_level, topic, turn_index::BIGINT AS turn_index, speaker, text,
  regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS ascii,
  len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM base)
"""
