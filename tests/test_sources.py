"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from parley.plans import analysis, events
from parley.sources import conversations as src
from parley.sources import sinks
from parley.streaming import files


def write(path, record):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record), encoding="utf-8")


def test_records(spark, tmp_path):
    write(tmp_path / "C1-P0" / "1.json", {"conversation_no": 1, "model": "m", "raw_output": "ParticipantA: Hi\nParticipantB: Yo"})
    write(tmp_path / "C3-P1" / "2.json", {"condition": "C3-P1", "conversation_no": 2, "models": {"ParticipantA": "x", "ParticipantB": "y"}, "turns": [["ParticipantA", " a "], ["ParticipantB", ""]], "n_turns": 2})
    write(tmp_path / "C3-P1" / "3.json", {"condition": "C3-P1", "conversation_no": 3, "turns": [], "raw_output": "none"})
    write(tmp_path / "C4-P0.broken" / "4.json", {"conversation_no": 4, "turns": [["ParticipantA", "z"]]})
    records = src.read_records(spark, str(tmp_path))
    assert sorted((r.condition, r.architecture, r.prompt_level, r.conversation_no) for r in records.collect()) == [("C1-P0", "C1", "P0", 1), ("C3-P1", "C3", "P1", 2), ("C3-P1", "C3", "P1", 3)]
    assert {r.conversation_no: r.models for r in records.collect()}[1] == {"*": "m"}
    turns = sorted((r.conv_id, r.turn_index, r.speaker, r.text) for r in src.record_turns(records).collect())
    assert turns == [("C1-P0/1", 0, "ParticipantA", "Hi"), ("C1-P0/1", 1, "ParticipantB", "Yo"), ("C3-P1/2", 0, "ParticipantA", " a "), ("C3-P1/2", 1, "ParticipantB", "")]
    kept = src.record_turns(records, keep=("file", "models", "n_turns")).filter("conversation_no = 2").first()
    assert kept.file.endswith("/C3-P1/2.json") and kept.models == {"ParticipantA": "x", "ParticipantB": "y"} and kept.n_turns == 2
    assert src.record_turns(records, "strict").filter("conv_id = 'C3-P1/2'").count() == 1
    assert src.read_records(spark, str(tmp_path), ["C1-P0"]).count() == 1
    assert src.read_records(spark, str(tmp_path), broken=True).count() == 4


def test_human_corpus(spark, tmp_path):
    head = "swda,act_tag,caller,utterance_index,subutterance_index,text\n"
    for name, body in (("sw_0001_4325", "x,o,A,1,1,{F Uh} hi /\nx,o,A,2,1,there /\nx,b,B,3,1,<laughter> yes /\n"), ("sw_0002_4330", "x,o,B,1,1,No /\n"), ("sw_0003_1", "x,o,A,1,1,<beep>\n")):
        p = tmp_path / "utt" / f"{name}.utt.csv"
        p.parent.mkdir(exist_ok=True)
        p.write_text(head + body)
    (tmp_path / "meta.csv").write_text("conversation_no,topic_description,prompt\n4325,OLD,p\n4325,PETS,p\n1,X,p\n")
    utterances = src.read_utterances(spark, str(tmp_path / "utt"))
    meta = src.read_metadata(spark, str(tmp_path / "meta.csv"))
    rows = src.human_turns(src.first_files(utterances, 5, meta), meta)
    assert sorted((r.conv_id, r.turn_index, r.speaker, r.text, r.topic) for r in rows.collect()) == [("SB/4325", 0, "A", "Uh hi there", "PETS"), ("SB/4325", 1, "B", "yes", "PETS")]
    assert src.first_files(utterances, 2).select("file").distinct().count() == 2


def test_alignment(spark, tmp_path):
    (tmp_path / "a.csv").write_text("condition,conv_id,turn_index,cosine_semanticL,lexical_tok2,lexical_lem2,lexical_tok3,lexical_lem3\nC1-P0,1,0,0.5,1,,3,NaN\nC1-P0,1,1,,x,,,\nC1-P0,1,11,0.1,1,1,1,1\n")
    rows = src.read_alignment(spark, str(tmp_path / "a.csv"))
    assert [(r.mean_cosine, r.n) for r in src.alignment_by_conversation(rows).collect()] == [(0.3, 2)]
    assert sorted((r.turn_index, r.section, r.lexical) for r in src.alignment_sections(rows).collect()) == [(0, "Earlier", 2.0), (1, "Earlier", None)]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, 0.5)], "n int, v double")
    assert sinks.write_csv([a, b], str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["n", "s", "v"] and sorted(map(tuple, back.collect()), key=str) == [("1", "x", None), ("2", None, "0.5")]
    assert not sinks.write_csv(a.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    records = spark.range(3).withColumnRenamed("id", "conversation_no")
    sinks.write_new(records, str(tmp_path / "out"))
    sinks.write_new(spark.range(5).withColumnRenamed("id", "conversation_no"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    sinks.write_json(a, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    turns = spark.createDataFrame([("c", 0, "A", 'a\tb "q"\n'), ("c", 1, "B", " ")], "conv_id string, turn_index long, speaker string, text string")
    rows = sinks.tsv_rows(turns)
    assert [r.content for r in rows.collect()] == ["a b q"]
    sinks.write_tsv(rows, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 1
    sinks.write_tsv(rows, str(tmp_path / "one"), folders=False)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "one")).columns == ["conv_id", "participant", "content"]
    assert sinks.write_summary(spark.createDataFrame([(1.0, "c", 2)], "m double, condition string, n int"), str(tmp_path / "wide"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "wide")).collect()] == [("c", "2", "1.0")]
    assert sinks.wide_summary(spark.createDataFrame([(1.0, "c", 2)], "m double, condition string, n int")).columns == ["condition", "n", "m"]


def test_stream_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "user", "c")], files.TURNS)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    query = files.each_batch(files.turn_stream(spark, str(tmp_path / "in")), lambda df, n: seen.append((n, df.filter(F.col("role") == "user").count())), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sum(n for _, n in seen) == 2


def test_streams_of_table_folders(spark, sf_dir, tmp_path):
    """A table that is a folder of files streams as one that is a file; names of the files don't matter."""
    for table in ("conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    for i, file in enumerate(sorted((tmp_path / "conversations.parquet").glob("*.parquet"))):
        file.rename(file.with_name(f"rows-{i}"))
    for query in (analysis.stream_roles, events.stream_sessions, events.stream_followed):
        own, whole = ([tuple(r) for r in query(spark, d).collect()] for d in (str(tmp_path), sf_dir))
        assert own and sorted(own, key=repr) == sorted(whole, key=repr)
