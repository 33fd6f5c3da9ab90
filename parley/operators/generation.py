"""What surrounds generation: targets, resuming, personas, prompts; the model is a function on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx

SEED_TURNS = "ParticipantA: Hello!\nParticipantB: Hello!"


def targets(files: DataFrame, metadata: DataFrame, n: int) -> DataFrame:
    """The first n files, by name, of conversations with metadata."""
    return files.join(metadata.select("conversation_no"), "conversation_no", "left_semi").orderBy("file").limit(n)


def chosen(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Named conversations that have metadata; ids keep their place column."""
    return ids.join(metadata, "conversation_no")


def todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done.select("conversation_no"), "conversation_no", "left_anti")


def age(talk_day: Column, birth_year: Column) -> Column:
    """1900 and the first two digits of the day, less the birth year; DEFAULT_AGE if that isn't a number."""
    year = F.substring(talk_day.cast("string"), 1, 2).try_cast("int") + 1900
    return F.coalesce(year - F.trim(birth_year.cast("string")).try_cast("int"), F.lit(lx.DEFAULT_AGE))


def gender(sex: Column) -> Column:
    return F.when(F.upper(F.trim(sex)).startswith("F"), "woman").otherwise("man")


def education(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in lx.EDUCATION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.trim(code)), F.lit(lx.EDUCATION["9"]))


def personas(metadata: DataFrame) -> DataFrame:
    """conversation_no, persona_a, persona_b, topic, sb_prompt."""
    one = lambda label, side: F.struct(
        F.lit(label).alias("label"), gender(F.col(f"{side}_caller_sex")).alias("gender"),
        age(F.col("talk_day"), F.col(f"{side}_caller_birth_year")).alias("age"), education(F.col(f"{side}_caller_education")).alias("education"),
    )
    return metadata.select("conversation_no", one("ParticipantA", "from").alias("persona_a"), one("ParticipantB", "to").alias("persona_b"), tx.title_case(F.col("topic_description")).alias("topic"), F.trim("prompt").alias("sb_prompt"))


def few_shot(turns: DataFrame, files: DataFrame, skip: int = 80, n_turns: int = 10) -> DataFrame:
    """One row, excerpt: the first n_turns of the first conversation, after skip files, with n_turns + 2 or more."""
    last = files.orderBy("file").limit(skip).agg(F.max("file").alias("last"), F.count("*").alias("skipped"))  # one row
    later = files.crossJoin(F.broadcast(last)).filter((F.col("skipped") == skip) & ((F.col("file") > F.col("last")) | F.lit(skip == 0)))
    long = turns.groupBy("conversation_no").agg(F.count("*").alias("n")).filter(F.col("n") >= n_turns + 2)
    first = later.join(long, "conversation_no").agg(F.min_by("conversation_no", "file").alias("conversation_no"))
    label = F.coalesce(F.try_element_at(F.create_map(F.lit("A"), F.lit("ParticipantA"), F.lit("B"), F.lit("ParticipantB")), F.col("speaker")), F.col("speaker"))
    rows = turns.join(F.broadcast(first), "conversation_no", "left_semi").filter(F.col("turn_index") < n_turns)
    lines = F.array_sort(F.collect_list(F.struct("turn_index", F.concat_ws(": ", label, "text").alias("line"))))
    return rows.agg(F.array_join(F.transform(lines, lambda t: t["line"]), "\n").alias("excerpt"))


def described(p: Column) -> Column:
    return F.format_string("a %d-year-old %s with %s", p["age"], p["gender"], p["education"])


# Fixed texts of the prompts.
LENGTH = "The conversation will have about 30 turns of talk; do not end it too early."
STYLE = (
    "Speak naturally and informally, the way people actually talk out loud on the phone. Keep each turn short — usually 1 to 3 sentences. "
    "Let the conversation end naturally when you both feel it is finished; do not pad or stretch it out."
)
PEER = (
    "You are an ordinary member of the public — NOT an AI assistant, agent, operator, or a representative of any company or service. "
    "The other caller is also an ordinary person; the two of you are equals who were each asked to phone a stranger and chat. "
    "Never say things like 'how can I help you' or 'is this the ... service', and do not offer help or recommendations as if it were your job — "
    "just share your own views and ask about theirs, the way two regular people would."
)
TOPIC = {"P0": "The topic of the conversation is: {goal}", "P1": "You were both asked to chat about this topic: {topic}. Shared discussion goal (talk it over together as equals, comparing your own experiences and opinions): {goal}"}
EXAMPLE = "\n\nHere is an example of a real, natural telephone conversation between two strangers on a DIFFERENT topic, to show the spoken style (short, casual back-and-forth):\n{example}\n(End of example.)\n"
PROMPTS = {
    ("C1", "P0"): "Write the log of a telephone conversation between two people who do not know each other and have equal roles in the discussion. ParticipantA is {a}. ParticipantB is {b}. {task} {length} The log starts with:\n{seed}\n"
    "Each line is one turn beginning with the speaker's label and a colon. Write the complete conversation, continuing from those greetings.",
    ("C1", "P1"): "Write a realistic telephone conversation between two ordinary people who do not know each other. ParticipantA is {a}. ParticipantB is {b}. {task} {style} {peer}{shot}\nIt opens with:\n{seed}\n"
    "Write the full conversation, one turn per line as 'ParticipantA: ...' / 'ParticipantB: ...'.",
    ("C2", "P0"): "Act like {me} in a phone conversation with someone you do not know. {task} {length} The conversation log so far is:\n'''{log}'''\nEach line is one turn; the speaker label precedes the colon. Your label is {speaker}. "
    "Your response is the next turn — respond to the last line but take the whole log into account. Do not include more than one turn, and do not write a speaker label.",
    ("C2", "P1"): "You are writing a realistic phone conversation between two ordinary people who do not know each other. ParticipantA is {a}; ParticipantB is {b}. {task} {style} {peer}{shot}\nConversation so far:\n{log}\n\n"
    "Write ONLY {speaker}'s next single turn — just the utterance, no label.",
    ("AG", "P0"): "Act like {me} in a telephone conversation with someone you do not know. {task} {length} Reply with only your next single turn of talk — no speaker label, one turn only.",
    ("AG", "P1"): "You are {me} on a telephone call with an ordinary stranger you just met. {task} {style} {peer}{shot} Reply with only what you say next, as a single spoken turn — no speaker label.",
}
CONNECTS = "(The phone connects — your partner is on the line.)"
UNDERWAY = "(The call is already underway.)"
QUIET = "(Your partner is quiet — continue if you wish.)"


def _filled(template: str, values: dict[str, Column]) -> Column:
    """template with its {names} replaced, as one concatenation."""
    parts: list[Column] = []
    while template:
        head, brace, tail = template.partition("{")
        parts += [F.lit(head)] if head else []
        name, _, template = tail.partition("}") if brace else ("", "", "")
        parts += [values[name]] if name else []
    return F.concat(*parts)


def prompts(rows: DataFrame, level: str, kind: str, example: str = "") -> DataFrame:
    """rows with messages array<struct<role, content>>.

    kind C1 (all at once), C2 (the next turn from the log), AG (one agent's view). rows: persona_a, persona_b, topic,
    sb_prompt; for C2 and AG also speaker (whose turn it is) and history array<struct<speaker, text>>.
    """
    form = "P0" if level == "P0" else "P1"
    a, b = F.col("persona_a"), F.col("persona_b")
    values = {"a": described(a), "b": described(b), "length": F.lit(LENGTH), "style": F.lit(STYLE), "peer": F.lit(PEER), "seed": F.lit(SEED_TURNS)}
    goal = F.coalesce(F.when(F.col("sb_prompt") != "", F.col("sb_prompt")), F.col("topic"))
    values["task"] = _filled(TOPIC[form], {"goal": goal, "topic": F.col("topic")})
    values["shot"] = F.lit(EXAMPLE.replace("{example}", example) if level == "P2" and example else "")
    message = lambda role, content: F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"))
    if kind != "C1":
        own = F.col("speaker")
        values |= {"speaker": own, "me": F.when(own == a["label"], described(a)).otherwise(described(b))}
        log = F.array_join(F.transform("history", lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")
        values["log"] = F.when(F.size("history") > 0, log).otherwise(SEED_TURNS)
    text = _filled(PROMPTS[kind, form], values)
    if kind != "AG":
        return rows.withColumn("messages", F.array(message("user", text)))
    note = lambda s: F.array(message("user", F.lit(s)))
    none = F.filter(note(""), lambda m: F.lit(False))
    said = F.transform("history", lambda t: message(F.when(t["speaker"] == own, "assistant").otherwise("user"), t["text"]))
    is_own = lambda i: F.element_at("history", i)["speaker"] == own
    talk = F.when(F.size("history") == 0, note(CONNECTS)).otherwise(F.concat(F.when(is_own(1), note(UNDERWAY)).otherwise(none), said, F.when(is_own(-1), note(QUIET)).otherwise(none)))
    return rows.withColumn("messages", F.concat(F.array(message("system", text)), talk))


def next_speaker(turn: Column) -> Column:
    return F.when(turn % 2 == 0, "ParticipantA").otherwise("ParticipantB")


def generated(rows: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """rows with reply: what model answers to messages, a batch at a time; clean replies and overruns follow from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=model(frame["messages"]))

    out = rows.mapInPandas(run, rows.withColumn("reply", F.lit("")).schema)
    first = tx.first_utterance(F.col("reply"))
    return out.withColumn("turn", tx.strip_residue(first["text"])).withColumn("ran_past", first["ran_past"])


def emissions(replies: DataFrame) -> DataFrame:
    return replies.groupBy("conversation_no").agg(F.sum(F.col("ran_past").cast("long")).alias("multi_turn_emissions"))
