"""Token counts of byte-level BPE by merging ragged arrays rank by rank.

A text is cut at blanks first, where no pre-token reaches across, and the counts of recent pieces are remembered. The
pieces of a batch of texts that aren't known are cut into pre-tokens by the file's own pattern, and these
become one flat array of symbols with the sizes of its sequences. In each round every
sequence's lowest-ranked pair is found by one segmented minimum, and all its occurrences in all sequences
are merged at once; a sequence without a ranked pair leaves, and the symbols it has left are its count.
A pair that holds a merged symbol ranks after the merge that made the symbol, so merging all occurrences
of a sequence's lowest pair is what a queue of single merges does.

The tokenizer file is a parameter; each executor reads it by its path. Texts stay whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.bpe import _NEWER_LETTER, NEWER_LETTERS, NEWER_NUMBERS, SPACE_CLASS, WIDE, _class_of, byte_symbols
from parley.llm.lineage import small_batches

# Fixed value: how byte-level BPE of this kind cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A document with more tokens is over the limit.
LIMIT = 512
#: Pieces that a worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 600_000, 48
#: Characters of text, and pre-tokens, that are worked on at once, about.
TEXT_CHARS, PIECE_WORDS = 1 << 20, 1 << 18
NO_RANK = np.iinfo(np.int32).max


class Merges:
    """Ranks of symbol pairs in a hash table of numpy arrays."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        """pairs: left * WIDE + right, by rank; made: the symbol of each."""
        self.made = made.astype(np.int32)
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.zeros(len(self.keys), np.int32)
        self.probes = 0
        left = np.arange(len(pairs))
        at = self._slot(pairs)
        while len(left):  # each free place goes to the first that asks for it, the others go on to the next place
            free = self.keys[at] < 0
            place, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[place], self.ranks[place] = pairs[left[took]], left[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], at[rest] + 1
            self.probes += 1
            if len(at) and at.max() >= len(self.keys):
                self.keys = np.append(self.keys, np.full(64, -1, np.int64))
                self.ranks = np.append(self.ranks, np.zeros(64, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it has none."""
        keys = left.astype(np.int64) * WIDE + right
        out, at, asked = np.full(len(keys), NO_RANK, np.int32), self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            out[asked[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            asked, at, keys = asked[on], at[on] + 1, keys[on]
        return out

    def survivors(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence; sizes: of the sequences in symbols, 1 or more."""
        counts, who = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        rank = np.full(len(symbols), NO_RANK, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.of(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = NO_RANK  # a sequence's last symbol begins no pair
        while len(who):
            low = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            ended = low == NO_RANK
            if ended.any():
                counts[who[ended]] = sizes[ended]
                on = np.repeat(~ended, sizes)
                symbols, rank, sizes, who, low = symbols[on], rank[on], sizes[~ended], who[~ended], low[~ended]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            # The pair of a symbol with itself may overlap with the next one: every other of a run, from its first.
            opens = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            place = at - np.repeat(at[opens], np.diff(np.append(opens, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            ends = np.cumsum(sizes)
            sizes = sizes - np.bincount(np.searchsorted(ends, at, "right"), minlength=len(sizes))
            now = at - np.arange(len(at))  # places after the others are gone
            symbols, rank = symbols[stay], rank[stay]
            anew = np.zeros(len(symbols), bool)
            anew[now] = anew[now[now > 0] - 1] = True
            last = np.cumsum(sizes) - 1
            anew[last], rank[last] = False, NO_RANK
            anew = np.flatnonzero(anew)
            rank[anew] = self.of(symbols[anew], symbols[anew + 1])
        return counts


class Counter:
    """Counts tokens as one tokenizer file of byte-level BPE has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = Merges(
            np.array([vocab[a] * WIDE + vocab[b] for a, b in pairs], np.int64).reshape(-1), np.array([vocab[a + b] for a, b in pairs], np.int64)
        )
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], np.int32)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        words = PATTERN.replace(r"[^\s", f"[^{SPACE_CLASS}").replace(r"\s", f"[{SPACE_CLASS}]").replace(r"\S", f"[^{SPACE_CLASS}]")
        self.words = regex.compile(words)
        for name, newer in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
            words = words.replace(name, f"[{name}--{_class_of(newer)}]")
        self.words_older = regex.compile(words, regex.V1)
        self.gaps = regex.compile(f"(?<=[^{SPACE_CLASS}]) ")
        self.unsafe = regex.compile(f"[{SPACE_CLASS}] ")
        #: Tokens of a piece that opens a text, and of one that a blank leads.
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}

    def pieces(self, text: str) -> list[str]:
        """The text cut at each blank that follows something other than white space, without that blank. No pre-token
        reaches across the place before it, nor does what a pre-token looks ahead at."""
        return self.gaps.split(text) if self.unsafe.search(text) else text.split(" ")

    def pre_tokens(self, piece: str) -> Iterator[list[str]]:
        pattern = self.words_older if not piece.isascii() and _NEWER_LETTER.search(piece) else self.words
        if len(piece) <= 4 * TEXT_CHARS:
            yield pattern.findall(piece)
            return
        found = pattern.finditer(piece)  # long and without a blank: a list of all its pre-tokens might be large
        while part := [m[0] for m in islice(found, PIECE_WORDS)]:
            yield part

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out, lo = [], 0
        while lo < len(words):
            hi, held = lo, 0
            while hi < len(words) and (held < TEXT_CHARS or hi == lo):
                held += len(words[hi])
                hi += 1
            coded = [w.encode() for w in words[lo:hi]]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            out += self.merges.survivors(self.of_byte[np.frombuffer(b"".join(coded), np.uint8)], sizes).tolist()
            lo = hi
        return out

    def learn(self, pieces: list[str], lead: str) -> None:
        """Has the pieces, which follow lead, known."""
        known = self.known[lead]
        # One pattern match for all that neither need nor end with white space: the blanks between them are safe cuts.
        joined = [p for p in pieces if lead and p and len(p) <= TEXT_CHARS and not p[-1].isspace()]
        if joined:
            words = [w for part in self.pre_tokens(lead + lead.join(joined)) for w in part]
            distinct = [*set(words)]
            counts = dict(zip(distinct, self.lengths(distinct)))
            of_word = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            opens = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) + 1)[:-1]
            first = np.append(0, np.searchsorted(ends, opens) + 1)
            known.update(zip(joined, np.add.reduceat(of_word, first).tolist()))
        for piece in pieces:
            if piece not in known:
                known[piece] = 0
                for part in self.pre_tokens(lead + piece):
                    distinct = [*set(part)]
                    counts = dict(zip(distinct, self.lengths(distinct)))
                    known[piece] += sum(map(counts.__getitem__, part))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; special strings in a text are one token each, null is empty."""
        totals, held, chars = [0] * len(texts), [], 0

        def settle() -> None:
            nonlocal held, chars
            for lead, lists in (("", [[p[0]] for _, p in held]), (" ", [p[1:] for _, p in held])):
                known, asked = self.known[lead], set().union(*lists)
                self.learn([p for p in asked if p not in known], lead)
                for (i, _), own in zip(held, lists):
                    totals[i] += sum(map(known.__getitem__, own))
                for p in asked:
                    if len(p) > REMEMBERED_CHARS:
                        del known[p]
                if len(known) > REMEMBERED:
                    self.known[lead] = {p: known[p] for p in asked if p in known}
            held, chars = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in filter(None, parts):
                held.append((i, self.pieces(part)))
                chars += len(part)
                if chars >= TEXT_CHARS:
                    settle()
        settle()
        return totals


@cache
def counter_of(path: str) -> Counter:
    """One for each file in a Python process, so that what it remembers serves several tasks."""
    return Counter(path)


def _batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of rows that end with a text: the other columns, n_bytes, n_tokens."""
    counter = counter_of(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        counts, lo = [], 0
        while lo < len(texts):  # not all of a batch's texts are Python strings at once
            hi = min(len(texts), lo + 64)
            counts += counter.counts(texts.slice(lo, hi - lo).to_pylist())
            lo = hi
        kept = batch.select(range(batch.num_columns - 1))
        sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*kept.columns, sizes, pa.array(counts, pa.int64())], names=[*kept.schema.names, "n_bytes", "n_tokens"])


def counted(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """keep's columns of docs (default: all but the text), n_bytes, n_tokens and over_limit of each whole text, row for row.

    A null text counts as empty: 0 bytes and tokens. Repeated rows each get their own result; an empty table gives an
    empty table. Kept columns that are named like a result give way to it.
    """
    small_batches(docs.sparkSession)
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c not in made]
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in made[:2]]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInArrow(lambda it: _batches(it, path), T.StructType(fields))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_counts(spark, sf_dir):
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_path(), keep=["doc_id"])
