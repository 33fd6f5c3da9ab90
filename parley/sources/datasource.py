"""Records and utterances as data sources: batch and stream readers over many small files.

    spark.dataSource.register(Records)
    spark.read.format("dialogue_records").load(folder)
    spark.readStream.format("dialogue_records").load(folder)

A partition is a bundle of files, so a million small records are not a million tasks. The driver lists names only; executors read. Paths may be anything that
pyarrow.fs knows. A file that doesn't parse gives one row that says so, under corrupt, and never stops a run.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: The columns that say where a row comes from, and why a file has none.
FILE = "file string, folder string, corrupt string"


def fitted(value, kind: T.DataType):
    """value as the type, null where it is something else, as a reader of JSON has it."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        most = 1 << (63 if isinstance(kind, T.LongType) else 31)
        return value if isinstance(value, int) and not isinstance(value, bool) and -most <= value < most else None
    if isinstance(kind, T.ArrayType):
        return [fitted(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if not isinstance(value, dict):
        return None
    if isinstance(kind, T.MapType):
        return {k: fitted(x, kind.valueType) for k, x in value.items()}
    return tuple(fitted(value.get(f.name), f.dataType) for f in kind.fields)


@dataclass
class Bundle(InputPartition):
    files: tuple[str, ...]


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files:
    """The files below a folder whose names match, and their rows."""

    def __init__(self, path: str, pattern: str, bundle: int, schema: T.StructType, parse):
        self.path, self.pattern, self.bundle, self.schema, self.parse = path, pattern, bundle, schema, parse

    def listed(self) -> list[tuple[int, str]]:
        """(time of change, path), in that order. Files and folders whose names hold .broken are left out."""
        from pyarrow import fs

        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [x for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern) and ".broken" not in x.path[len(root) :]]
        return sorted((x.mtime_ns or 0, x.path) for x in files)

    def bundles(self, files: list[str]) -> list[Bundle]:
        return [Bundle(tuple(files[i : i + self.bundle])) for i in range(0, len(files), self.bundle)]

    def rows(self, part: Bundle) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        own = [f for f in self.schema.fields if f.name not in ("file", "folder", "corrupt")]
        for file in part.files:
            where = (file, file.rsplit("/", 2)[-2] if "/" in file else "")
            try:
                with system.open_input_stream(file) as f:
                    records = self.parse(f.read(), file)
            except (ValueError, OSError) as e:
                yield (*[None] * len(own), *where, f"{type(e).__name__}: {e}")
                continue
            for r in records:
                yield (*(fitted(r.get(f.name), f.dataType) for f in own), *where, None)


class Batch(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self) -> list[Bundle]:
        return self.files.bundles([path for _, path in self.files.listed()]) or [Bundle(())]

    def read(self, partition: Bundle) -> Iterator[tuple]:
        return self.files.rows(partition)


class Stream(DataSourceStreamReader):
    """Files in the order of their change; an offset is the last one's time and path. A file that appears with an older
    time than what was read already isn't seen: move files in when they are whole."""

    def __init__(self, files: Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        after, upto = ((x["time"], x["path"]) for x in (start, end))
        return self.files.bundles([path for time, path in self.files.listed() if after < (time, path) <= upto])

    def read(self, partition: Bundle) -> Iterator[tuple]:
        return self.files.rows(partition)


class _Source(DataSource):
    """Options: path; files, the most in a partition (default 200); pattern."""

    PATTERN, COLUMNS = "*", ""

    @staticmethod
    def parse(data: bytes, file: str) -> list[dict]:
        raise NotImplementedError

    def schema(self) -> str:
        return f"{self.COLUMNS}, {FILE}"

    def _files(self, schema: T.StructType) -> Files:
        if not self.options.get("path"):
            raise ValueError("a folder is needed: load(path)")
        return Files(self.options["path"], self.options.get("pattern", self.PATTERN), max(1, int(self.options.get("files", 200))), schema, self.parse)

    def reader(self, schema: T.StructType) -> Batch:
        return Batch(self._files(schema))

    def streamReader(self, schema: T.StructType) -> Stream:
        return Stream(self._files(schema))


class Records(_Source):
    """JSON records of dialogues: an object or a list of them in a file."""

    PATTERN = "*.json"
    COLUMNS = (
        "condition string, architecture string, prompt_level string, model string, models map<string,string>, conversation_no long, topic string, sb_prompt string, "
        "persona_a struct<label:string,gender:string,age:int,education:string>, persona_b struct<label:string,gender:string,age:int,education:string>, raw_output string, "
        "turns array<array<string>>, n_turns long, multi_turn_emissions long"
    )

    @classmethod
    def name(cls) -> str:
        return "dialogue_records"

    @staticmethod
    def parse(data: bytes, file: str) -> list[dict]:
        found = json.loads(data)
        found = found if isinstance(found, list) else [found]
        if not all(isinstance(r, dict) for r in found):
            raise ValueError("no record")
        return found


class Utterances(_Source):
    """Utterance tables of the human corpus, columns picked by name."""

    PATTERN = "sw_*.utt.csv"
    COLUMNS = "act_tag string, caller string, utterance_index long, subutterance_index long, text string"

    @classmethod
    def name(cls) -> str:
        return "dialogue_utterances"

    @staticmethod
    def parse(data: bytes, file: str) -> list[dict]:
        rows = csv.DictReader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)
        try:
            found = list(rows)
        except csv.Error as e:
            raise ValueError(str(e)) from e
        number = lambda x: int(x) if x and x.strip().lstrip("+-").isdigit() else None
        return [{**{k: v or None for k, v in r.items() if k}, **{k: number(r.get(k)) for k in ("utterance_index", "subutterance_index")}} for r in found]


def register(spark) -> None:
    for source in (Records, Utterances):
        spark.dataSource.register(source)


def corrupt_files(rows: DataFrame) -> DataFrame:
    """folder, files, corrupt: how many files gave rows, and how many didn't parse."""
    return rows.groupBy("folder").agg(F.countDistinct("file").alias("files"), F.count("corrupt").alias("corrupt"))
