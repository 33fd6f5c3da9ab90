"""Byte-pair encoding by a queue of merge ranks over a linked symbol list, and its decoding.

The tokenizer file is a parameter; it is read by its path on each executor, whose Python needs the
package that owns the file. Texts stay whole. A text is cut at white space first: no normal form, case
mapping, pattern match or merge reaches across white space, so a cut-out piece always has the same ids
and a bounded memory of recent pieces saves most of the work. The library's tables are of several ages, and
those of Python and its pattern module of others; the fixed values below make up for the difference, so that
every character of every plane is treated as there.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parley.llm.lineage import small_batches

#: White space as the tokenizer's pattern engine sees it.
SPACE_CLASS = "\t-\r \x85\xa0  -     　"
# Code points, hexadecimal, of the combining marks that came with Unicode 10 to 15.1, and of the one
# vowel sign that a pair composed since then ends with. To the tables of Unicode 9 they are characters that stay
# where they are, join with nothing and end a run of marks.
NEWER_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 "
    "11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF 11930"
)
# Code points of letters and numbers since Unicode 17, which are neither to its pattern engine.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capital letters since Unicode 16, and how far from each, hexadecimal, its small letter lies.
NEWER_CAPITALS = {
    "1C89": 0x1, "A7CB": -0xA567, "A7CC": 0x1, "A7CE": 0x1, "A7D2": 0x1, "A7D4": 0x1, "A7DA": 0x1, "A7DC": -0xA641,
    "10D50-10D65": 0x20, "16EA0-16EB8": 0x1B,
}
#: Pieces and words that a worker remembers in each of two generations, and the longest of them in characters. Words
#: that come back too late to be remembered take most of the time.
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
#: Ids are below this.
WIDE = 1 << 20
#: Texts are handed on in Arrow batches of about so many bytes of output.
BATCH_BYTES = 8 << 20
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.field("element", pa.int32(), False))),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _class_of(ranges: str) -> str:
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in ranges.split()]
    return "[" + "".join("-".join(map(regex.escape, e)) for e in ends) + "]"


def _shifts(capitals: dict[str, int]) -> dict[int, int]:
    ends = [([int(x, 16) for x in r.split("-")], step) for r, step in capitals.items()]
    return {c: c + step for e, step in ends for c in range(e[0], e[-1] + 1)}


_NEWER = regex.compile(f"({_class_of(NEWER_MARKS)}+)")
_NEWER_LETTER = regex.compile(_class_of(f"{NEWER_LETTERS} {NEWER_NUMBERS}"))
_SMALL = _shifts(NEWER_CAPITALS) | {ord("Σ"): ord("σ")}  # case mapping is by character: no form of its own at a word's end
_CAPITAL = regex.compile(_class_of(" ".join(NEWER_CAPITALS)) + "|Σ")


def lowered(text: str) -> str:
    return (text.translate(_SMALL) if _CAPITAL.search(text) else text).lower()


def composed(text: str) -> str:
    """The normal form NFC of Unicode 9."""
    if not _NEWER.search(text):
        return unicodedata.normalize("NFC", text)
    parts = _NEWER.split(text)  # those marks stand at odd places
    parts[::2] = [unicodedata.normalize("NFC", x) for x in parts[::2]]
    return "".join(parts)


def unpacked(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


class Tokenizer:
    """Encoder and decoder of one tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: id of the whole of each rank; by left id: right id -> rank
        self.whole = [self.vocab[a + b] for a, b in pairs]
        self.ranks: list[dict[int, int]] = [{}] * (max(self.strings) + 1)  # one for all that begin no pair
        for rank, (a, b) in enumerate(pairs):
            if not self.ranks[left := self.vocab[a]]:
                self.ranks[left] = {}
            self.ranks[left][self.vocab[b]] = rank
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        words = split["pattern"]["Regex"].replace(r"\s", SPACE_CLASS)
        self.words = regex.compile(words)
        for name, newer in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
            words = words.replace(name, f"[{name}--{_class_of(newer)}]")
        self.words_older = regex.compile(words, regex.V1)
        self.gaps = regex.compile(f"[{SPACE_CLASS}]+")
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.of_word = _Remembered(lambda word: self._with_strings(self.merged(word.encode())))
        self.known = _Remembered(self.piece)

    def merged(self, word: bytes) -> bytes:
        """Ids of one word, packed as little-endian 32-bit numbers, which take a third of a tuple's room.

        Symbols form a doubly linked list. The queue holds rank and place of adjacent pairs in one number,
        and so does at, by place, for the pair that stands there now; an entry that isn't there is stale, and skipped.
        """
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        n, ranks, whole = len(ids), self.ranks, self.whole
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        at = [-1 if (m := ranks[x].get(y)) is None else m * n + i for i, (x, y) in enumerate(pairwise(ids))]
        queue = [m for m in at if m >= 0]
        at.append(-1)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top % n
            if at[i] != top:
                continue
            ids[i] = own = whole[top // n]
            j = after[i]
            ids[j] = at[i] = at[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := ranks[own].get(ids[k])) is not None:
                    at[i] = m = m * n + i
                    heappush(queue, m)
            if (h := before[i]) >= 0:
                if (m := ranks[ids[h]].get(own)) is None:
                    at[h] = -1
                else:
                    at[h] = m = m * n + h
                    heappush(queue, m)
        ids = [x for x in ids if x >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a piece without white space, and their strings; those of special tokens in it stand for their ids."""
        for mark in self.special:
            if mark in text:
                break
        else:
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at : m.start()]), self._with_strings(struct.pack("<I", self.special[m[0]]))]
            at = m.end()
        return self._joined([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> tuple[bytes, str]:
        lower = text.lower() if text.isascii() else lowered(composed(text))
        if lower.isalpha():
            return self.of_word[lower]
        if lower[:-1].isalpha() and lower[-1].isascii():  # letters and one mark or digit, which stands alone
            (ids, strings), (last, mark) = self.of_word[lower[:-1]], self.of_word[lower[-1]]
            return ids + last, f"{strings} {mark}"
        words = self.words_older if not lower.isascii() and _NEWER_LETTER.search(lower) else self.words
        return self._joined([self.of_word[m] for m in words.findall(lower)])

    def _with_strings(self, ids: bytes) -> tuple[bytes, str]:
        return ids, self.decode(unpacked(ids))

    @staticmethod
    def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])

    def pieces(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
            return [x for x in self.gaps.split(text) if x]
        return text.split()

    def encode(self, text: str) -> list[int]:
        return unpacked(b"".join([self.piece(p)[0] for p in self.pieces(text)]))

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so the strings of the vocabulary are joined by one blank."""
        return " ".join([self.strings[i] for i in ids])

    def both(self, text: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids, and the decoded text."""
        return self._joined([self.known[p] for p in self.pieces(text)])


class _Remembered(dict):
    """text -> value(text). A full generation becomes the older one, which is asked before value is."""

    def __init__(self, value: Callable[[str], object]):
        self.value, self.older = value, {}

    def __missing__(self, text: str) -> object:
        if (found := self.older.get(text)) is None:
            found = self.value(text)
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


@cache
def tokenizer_of(path: str) -> Tokenizer:
    """One for each file in a Python process, so that what it remembers serves several tasks."""
    return Tokenizer(path)


def _batches(batches: Iterator[pa.RecordBatch], path: str, text: str, keep: list[str], outputs: list[str]) -> Iterator[pa.RecordBatch]:
    tokenizer = tokenizer_of(path)

    def made(rows: list[tuple[bytes, str]], kept: pa.RecordBatch) -> pa.RecordBatch:
        columns = []
        for name in outputs:
            if name == "ids":
                counts = [len(ids) // 4 for ids, _ in rows]
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                flat = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(x for x, _ in rows))])
                columns.append(pa.ListArray.from_arrays(offsets, flat, type=OUTPUTS["ids"][1]))
                continue
            of = {
                "n_tokens": lambda ids, dec: len(ids) // 4,
                "decoded": lambda ids, dec: dec,
                "ids_sha256": lambda ids, dec: hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": lambda ids, dec: hashlib.sha256(dec.encode()).hexdigest(),
            }[name]
            columns.append(pa.array([of(*r) for r in rows], OUTPUTS[name][1]))
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*keep, *outputs])

    for batch in batches:
        texts, kept = batch.column(batch.schema.get_field_index(text)), batch.select(keep)
        rows, start, held = [], 0, 0
        for i in range(len(texts)):
            rows.append(tokenizer.both(texts[i].as_py() or ""))
            held += len(rows[-1][0]) + len(rows[-1][1])
            if held >= BATCH_BYTES:
                yield made(rows, kept.slice(start, len(rows)))
                rows, start, held = [], i + 1, 0
        if rows:
            yield made(rows, kept.slice(start, len(rows)))


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """keep's columns of docs and the asked OUTPUTS of each whole text, row for row.

    A null text counts as empty: no ids and an empty decoded text. Repeated rows each get their own
    result; an empty table gives an empty table. Kept columns named like an output give way to it.
    """
    small_batches(docs.sparkSession)
    outputs = list(outputs)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    fields = [docs.schema[c] for c in keep] + [T.StructField(o, OUTPUTS[o][0]) for o in outputs]
    needed = docs.select(*dict.fromkeys([*keep, text]))
    return needed.mapInArrow(lambda it: _batches(it, path, text, keep, outputs), T.StructType(fields))


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, production_path(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
