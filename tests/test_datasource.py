"""Records and utterances as data sources: the rows of the built-in readers, in batch and as a stream; corrupt files."""

import json

from pyspark.sql import functions as F

from parley.sources import conversations as src
from parley.sources import datasource


def fill(root, start=0, n=30):
    for i in range(start, start + n):
        folder = root / f"C{i % 4 + 1}-P{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        record = {"conversation_no": i, "topic": f"t{i % 5}", "turns": [["ParticipantA", f"a{i}"], ["ParticipantB", "é"]], "n_turns": 2, "persona_a": {"label": "A", "age": 30 + i, "gender": None, "more": 1}}
        record |= {"condition": folder.name} if i % 2 else {"model": "m"}
        record |= {"models": {"ParticipantA": "x"}} if i % 5 == 0 else {}
        (folder / f"{i}.json").write_text(json.dumps(record), encoding="utf-8")


COLUMNS = ["condition", "architecture", "prompt_level", "model", "models", "conversation_no", "topic", "sb_prompt", "persona_a", "persona_b", "raw_output", "turns", "n_turns", "multi_turn_emissions"]


def shown(df):
    return sorted(df.select(F.element_at(F.split("file", "/"), -1), *[F.to_json(F.struct(F.col(c).alias("v"))) for c in COLUMNS]).collect())


def test_records_batch_and_stream(spark, tmp_path):
    datasource.register(spark)
    root = tmp_path / "in"
    fill(root)
    (root / "C1-P0.broken").mkdir()
    (root / "C1-P0.broken" / "99.json").write_text("{}")
    rows = spark.read.format("dialogue_records").option("files", 7).load(str(root))
    assert rows.rdd.getNumPartitions() == 5
    want = shown(src.read_records(spark, str(root)))
    assert len(want) == 30 and shown(src.with_defaults(rows)) == want
    # Two runs of a stream over a folder that grows: every file once.
    def run():
        stream = src.with_defaults(spark.readStream.format("dialogue_records").option("files", 4).load(str(root)))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == want
    fill(root, 30, 5)
    run()
    got = shown(spark.read.parquet(str(tmp_path / "out")))
    assert len(got) == 35 and got == shown(src.read_records(spark, str(root)))


def test_corrupt(spark, tmp_path):
    datasource.register(spark)
    fill(tmp_path, 0, 8)
    for name, data in (("cut", b'{"conversation_no": 1, "tur'), ("bytes", b"\xff\xfe{}"), ("number", b"17"), ("empty", b"")):
        (tmp_path / "C1-P0" / f"{name}.json").write_bytes(data)
    (tmp_path / "C2-P1" / "list.json").write_text('[{"conversation_no": 50}, {"conversation_no": "x", "turns": 3, "n_turns": 1.5}]')
    rows = spark.read.format("dialogue_records").load(str(tmp_path))
    counts = {r.folder: (r.files, r.corrupt) for r in datasource.corrupt_files(rows).collect()}
    assert sum(n for n, _ in counts.values()) == 13 and counts["C1-P0"][1] == 4 and sum(c for _, c in counts.values()) == 4
    assert rows.filter("corrupt IS NULL").count() == 10
    odd = rows.filter("file LIKE '%list.json'").orderBy("conversation_no").collect()
    assert [(r.conversation_no, r.turns, r.n_turns) for r in odd] == [(None, None, None), (50, None, None)]
    assert spark.read.format("dialogue_records").load(str(tmp_path / "none")).count() == 0


def test_utterances(spark, tmp_path):
    datasource.register(spark)
    head = "swda,act_tag,caller,utterance_index,subutterance_index,text\n"
    for name, body in (("sw_0001_4325", 'x,o,A,1,1,"{F Uh} hi, /"\nx,b,B,3,,"<laughter>\nyes /"\n'), ("sw_0002_4330", "x,o,B,1,1,No /\n")):
        (tmp_path / f"{name}.utt.csv").write_text(head + body)
    own = spark.read.format("dialogue_utterances").load(str(tmp_path))
    picked = ["act_tag", "caller", "utterance_index", "subutterance_index", "text"]
    by_name = lambda df: sorted((tuple(r) for r in df.select(*picked, F.element_at(F.split("file", "/"), -1)).collect()), key=repr)
    assert by_name(own) == by_name(src.read_utterances(spark, str(tmp_path)))
    turns = src.human_turns(own.withColumn("conversation_no", src.conversation_no(F.col("file"))))
    assert sorted(r.text for r in turns.collect()) == ["No", "Uh hi,", "yes"]
