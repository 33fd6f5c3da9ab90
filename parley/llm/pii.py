"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans to them.

The field labels every word of every text. Its features are the shapes of the word and of its neighbours;
it is trained by gradient ascent from a small labelled table and decoded by Viterbi in numpy batches. A
word is known by its type: the features that it has, in which words are alike wherever they stand. So
scores are looked up by type, at the word and at its neighbours, for whole batches of texts at once.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import textbuf as tb
from parley.llm.lineage import small_batches

#: Of the fixed patterns, and of the field: it adds credentials to them.
KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
#: Rows of a labelled table that are read at most, chosen by hash.
MAX_LABELLED = 5000
#: Texts decoded together, words in such a group when there are several, and steps scored at once.
TOGETHER, GROUP_WORDS, STEPS = 256, 400_000, 512
#: Types of words with digits that a worker remembers.
REMEMBERED = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin inside a run of digits whose beginning didn't match, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, leftmost and non-overlapping within a kind, by kind, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # the local part is what stands before an @, so it is sought from there
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
            at = end - 1
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- words and their features

_MARKS = ".,;:!?\"'()[]{}<>*#$%&|"
#: Words that tell what the number after them is, alone or with a mark behind.
CUES = (
    "tel", "phone", "call", "mobile", "cell", "fax", "email", "mail", "write", "ip", "host", "server", "card", "visa", "account", "iban",
    "token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "access_key", "access_token", "bearer", "credential",
    "commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "id", "isbn", "order", "invoice", "version",
    "etag", "integrity", "data", "url", "file", "path", "passphrase", "pass", "pin", "login", "is", "was",
)
_AFTER = ("", ":", ".", ",", "=", "#")
_CLASSES = ("lower", "capital", "upper", "ended", "assign", "symbols", "mixed")


def shape(word: str) -> str:
    """Digits as 0, letters as a, runs as one, the rest as it is; of a word with more than 24 runs "long"."""
    s = re.sub(r"(.)\1+", r"\1", "".join("0" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word))
    return s if len(s) <= 24 else "long"


def _count(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"


def _marked_features(w: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Of a word with a digit or @ the features for itself, and those for its neighbours."""
    d, core = _digits(w), w.strip(_MARKS)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    letters = sum(c.isalpha() for c in core)
    value = re.split(r"[=:]", core.rstrip("="))[-1].strip(_MARKS)
    held = "".join(c for c, own in (("l", "[a-z]"), ("u", "[A-Z]"), ("d", "[0-9]"), ("s", r"[^A-Za-z0-9]")) if re.search(own, value))
    lead = re.match(r"[A-Za-z]{2,5}(?=[-_])", value)
    packed = len(value) >= 16 and re.fullmatch(r"[A-Za-z0-9_+/.~-]+", value) and re.search("[0-9]", value) and re.search("[A-Za-z]", value)
    form = shape(core) if len(d) < 20 and letters < 12 else "big"
    own = (
        f"shape={form}", f"digits={_count(len(d))}", f"letters={_count(letters)}",
        f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 4)}", f"plus={'+' in w}", f"open={'(' in w}",
        f"at={min(core.count('@'), 2)}", f"mail={bool(re.fullmatch(r'[^@]+@[^@.]+([.][^@.]+)+', core))}",
        f"quad={'no' if not quad else 'byte' if all(len(p) <= 3 and int(p) <= 255 for p in parts) else 'wide'}",
        f"luhn={not letters and 13 <= len(d) <= 19 and luhn(d)}", f"assign={'=' in w or '/' in w}", f"quoted={w[:1] in QUOTES}",
        f"packed={'no' if not packed else 'uuid' if re.fullmatch('[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}', value) else 'hex' if re.fullmatch('[0-9a-fA-F]+', value) else 'wide'}",
        f"length={_length(len(value))}", f"held={held}", f"held={held} length={_length(len(value))}", f"lead={lead[0].lower() if lead else ''}",
        f"url={'://' in w or core.startswith(('www.', 'data:'))}", f"slashes={min(core.count('/'), 3)}", f"file={bool(_FILE.search(core))}", f"unders={min(core.count('_'), 3)}",
        f"after={core[: -len(value)].lower() if packed and value and len(core) - len(value) < 20 and core.endswith(value) else ''}",
    )
    return own, (f"shape={form}", f"digits={_count(len(d))}", f"packed={bool(packed)}")


#: The end of a file's name.
_FILE = re.compile(r"[.](?:[A-Za-z][A-Za-z0-9]{1,4}|7z|mp[34])$")


def _length(n: int) -> str:
    """Lengths of values in steps that grow, with those that digests have apart."""
    return str(n) if n < 13 or n in (32, 40, 64, 128) else f"{n // 4 * 4}+" if n < 48 else "48+"


QUOTES = ("\"", "'", "`", "\u201c", "\u00ab")


class Types:
    """The types of words seen: each with its own features and those it gives its neighbours. Type 0 stands
    beyond the ends of a text; words without digit and @ have a type by class and cue."""

    def __init__(self):
        self.own: list[tuple[str, ...]] = [()]
        self.near: list[tuple[str, ...]] = [("beyond",)]
        hashes = {}
        for i, cue in enumerate(CUES):
            for mark in _AFTER:
                data = np.frombuffer((cue + mark).encode(), np.uint8)
                hashes[int(tb.words(data, np.array([0, len(data)]))[0][0])] = i + 1
        self.hashes = np.array(sorted(hashes), tb.U)
        self.cue_of = np.array([hashes[int(h)] for h in self.hashes])
        for cue in ("", *CUES):
            for kind in _CLASSES:
                self.own.append(("bias", f"class={kind}", f"cue={cue}"))
                self.near.append((f"class={kind}", f"cue={cue}"))
        #: Types of words, and by the features.
        self.fixed, self.marked, self.by_features = len(self.own), {}, {}

    def forget(self) -> bool:
        """Drops the types of words with digits if they are many."""
        if len(self.own) < REMEMBERED and len(self.marked) < 2 * REMEMBERED:
            return False
        del self.own[self.fixed :], self.near[self.fixed :]
        self.marked, self.by_features = {}, {}
        return True

    def of_marked(self, word: str) -> int:
        if (found := self.marked.get(word)) is None:
            own, near = _marked_features(word)
            key = (own, near)
            if (found := self.by_features.get(key)) is None:
                found = self.by_features[key] = len(self.own)
                self.own.append(("bias", *own))
                self.near.append(near)
            if len(word) <= 64 and len(self.marked) < 2 * REMEMBERED:
                self.marked[word] = found
        return found

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that offsets cut from data: types, starts and ends (bytes from the first row's start) of all
        words, and at which word each row begins."""
        h, s, e, rows = tb.words(data, offsets)
        if not len(s):
            return np.zeros(0, np.int32), s, e, rows
        own = data[offsets[0] : offsets[-1]]
        kind = _KIND[own]
        held = {}
        for name, bit in (("letter", 1), ("capital", 2), ("marked", 4)):
            held[name] = np.add.reduceat((kind & bit) > 0, np.stack([s, np.minimum(e, len(own) - 1)], 1).ravel(), dtype=np.int64)[::2]
            last = e == len(own)  # reduceat can't name the end
            held[name] += np.where(last & (s < e - 1), ((kind & bit) > 0)[-1], 0)
        n, letters, capitals = e - s, held["letter"], held["capital"]
        ended = (letters == n - 1) & (letters > 0) & (kind[e - 1] & 8 > 0)
        assign = (letters == 0) & ((own[s] == ord("=")) | (own[s] == ord(":")))
        group = np.select(
            [(letters == n) & (capitals == 0), (letters == n) & (capitals == 1) & (kind[s] & 2 > 0) & (n > 1), (letters == n) & (capitals == n), ended, assign, letters == 0],
            [0, 1, 2, 3, 4, 5], 6,
        )
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        cue = np.where(self.hashes[at] == h, self.cue_of[at], 0)
        types = (1 + cue * len(_CLASSES) + group).astype(np.int32)
        for i in np.flatnonzero(held["marked"]).tolist():
            types[i] = self.of_marked(own[s[i] : e[i]].tobytes().decode("utf-8", "replace"))
        return types, s, e, rows


#: Of each byte: 1 a letter (of the others, those beyond ASCII count as letters), 2 a capital, 4 a digit or @, 8 a mark that ends.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] |= 1
_KIND[65:91] |= 2
_KIND[[*range(48, 58), 64]] |= 4
_KIND[[ord(c) for c in ".,;:!?"]] |= 8


# ---- the labelled table


def labelled_rows(n: int = 1600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their spans (kind, start, end), made by rule: forms in use, and numbers that are none of them."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    wide = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 1)) + rng.choice("0123456789")

    def filler() -> str:
        w = "".join(rng.choice("aeinorstluéßñ") for _ in range(rng.randint(1, 10)))
        return rng.choice([w, w, w, w, w.capitalize(), w.upper(), w + rng.choice(".,;:!?"), w + rng.choice(["###", "***", "$$$", "!!", "%%%"])])

    def luhned(k: int) -> str:
        d = num(k)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def card() -> str:
        d = luhned(15)
        return rng.choice([d, *(mark.join(d[i : i + 4] for i in (0, 4, 8, 12)) for mark in " -.")])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        cue = rng.choice(["tel", "phone", "call", "mobile", "fax", "tel:", "phone:", "Call"])
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+44 {num(2)} {num(4)} {c}", f"+49 {a} {num(7)}", f"00{num(2)} {a} {num(7)}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{cue} \0{a} {b} {c}", f"{cue} \0{num(10)}"])

    def email() -> str:
        word = lambda: "".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 8)))
        user, host, top = word(), word(), rng.choice(["com", "org", "net", "de", "fr", "es"])
        return rng.choice([f"{user}@{host}.{top}", f"{user}.{word()}{num(2)}@{host}.{top}", f"{user}@{host}.{word()}.{top}", f"{user}[@]{host}.{top}", f"{user}@{host}[.]{top}"])

    def ip() -> str:
        q = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".".join(q), ".".join(q), "[.]".join(q)])

    def secret() -> str:
        value = rng.choice([hexa(39) + num(1), hexa(31) + num(1), wide(32), wide(40), wide(24), f"sk-{wide(32)}", f"ghp_{wide(36)}", f"AKIA{wide(16).upper()}"])
        cue = rng.choice(["token", "secret", "password", "api_key", "key", "access_token", "Token", "API_KEY", "pwd"])
        if rng.random() < 0.35:
            value, cue = short(), rng.choice(["password", "Password", "passwd", "pwd", "passphrase", "pass", "login"])
            return rng.choice([f"{cue}: \0{value}", f"{cue}: \0{value}", f"{cue}=\0{value}", f"{cue} is \0{value}", f"{cue} was \0{value}", f'{cue}: \0"{value}"', f"{cue} \0{value}", f"{cue} = \0{value}"])
        return rng.choice([f'{cue} = \0"{value}"', f'{cue} = \0"{value}"', f"{cue}: \0{value}", f"{cue}=\0{value}", f"Bearer \0{value}", f'{cue}="\0{value}"', f"{cue} \0{value}"])

    def short() -> str:
        """A password: letters with digits or marks in it."""
        stem = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
        mixed = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789!$%&*_-+") for _ in range(rng.randint(8, 15))) + num(1) + rng.choice("abcXYZ")
        return rng.choice([mixed, mixed, stem.capitalize() + num(rng.randint(2, 4)), stem + num(rng.randint(1, 4)) + rng.choice(["", "!", "#", "x", "A"]) + "q", stem[:3] + num(2) + stem[3:].upper()])

    def name() -> str:
        return "".join(rng.choice("aeinorstlucdm") for _ in range(rng.randint(2, 8)))

    def place() -> str:
        """What looks packed and is no secret: addresses, paths, files, digests, data."""
        host, ending = f"{name()}.{rng.choice(['org', 'com', 'net', 'io', 'de'])}", rng.choice(["html", "js", "css", "png", "jpg", "pdf", "zip", "tar.gz", "log", "json", "parquet", "py"])
        blob = rng.choice([wide(rng.randint(12, 64)), hexa(rng.choice([8, 12, 16, 20, 32, 40])), num(rng.randint(3, 12)), f"{name()}-{num(4)}", f"{name()}{num(2)}"])
        url = rng.choice(["https://", "http://", "https://www.", "www.", "ftp://"]) + host
        return rng.choice([
            f"{url}/{name()}/{blob}", f"{url}/{blob}", f"{url}/{name()}?id={blob}", f"{url}/{name()}/{blob}/{name()}.{ending}", f"{url}/{name()}-{num(4)}/{num(2)}/{blob}", f"{url}:{num(4)}/{name()}?{name()}={num(3)}&{name()}={blob}",
            f"url: {url}/{blob}", f"see {url}/{blob}#{name()}", f'href="{url}/{blob}"', f"/{name()}/{name()}/{blob}", f"/{name()}/{name()}{num(1)}/{name()}.{ending}", f"./{name()}/{blob}.{ending}", f"C:\\{name()}\\{blob}.{ending}", f"path: /{name()}/{blob}",
            f"{name()}-{blob}.{ending}", f"{blob}.{ending}", f"{name()}_{blob}.{ending}", f"file {name()}-{blob}.{ending}", f"file: {blob}.{ending}", f"{name()}.{hexa(8)}.{ending}",
            f'ETag: "{hexa(rng.choice([16, 20, 32, 40]))}"', f'etag: W/"{blob}"', f"ETag: {hexa(32)}", f"integrity sha384-{wide(64)}", f"sha512-{wide(44)}==", f"digest: {hexa(64)}", f"checksum {hexa(rng.choice([8, 32, 40]))}", f"hash {hexa(40)}",
            f"data {wide(44)}", f"data: {wide(rng.randint(20, 60))}", f"data:image/png;base64,{wide(48)}", wide(44), wide(rng.randint(16, 60)), hexa(rng.choice([16, 24, 32, 40, 64])), f"id {hexa(24)}", f"id: {wide(22)}", f"{name()}: {wide(rng.randint(20, 40))}", f"{name()} = {hexa(16)}",
            f"{name()}{num(2)}-{name()}-{num(3)}", f"{name()}_{name()}{num(2)}", f"{name().upper()}-{num(5)}", f"#{hexa(6)}", f"0x{hexa(8)}", f"rev {hexa(7)}", f"{hexa(7)}..{hexa(7)}", f"@{name()}_{name()}", f"@{name()}{num(2)}", f"@{name()}", f"node{num(2)}.{host}", f"{name()}@{num(1)}.{num(2)}.{num(1)}",
        ])

    def said() -> str:
        """Names of secrets without one."""
        cue = rng.choice(["password", "token", "key", "secret", "pwd", "pass", "passphrase", "login"])
        return rng.choice([
            f"{cue} {num(1)}", f"{cue} of {num(1)}-{num(2)} letters", f"{cue}: {num(1)} letters", f"{num(4)} {cue}s", f"{cue} {num(2)} of {num(3)}", f"{cue} in 20{num(2)}", f"{cue} (v{num(1)}.{num(1)})", f"{cue} on page {num(2)}", f"{cue} was changed on 20{num(2)}-{num(2)}-{num(2)}",
            f"{cue} at {num(2)}:{num(2)}", f"{cue} {num(3)}%", f"{cue} is {num(2)} days old", f"{cue} is {num(1)}x longer", f"{cue} is in {name()}{num(1)}.txt", f"reset your {cue} at https://{name()}.org/{name()}?step={num(1)}", f"{cue} store {name()}-{num(2)}", f"{cue} for node{num(2)}", f"{cue} count: {num(4)}",
        ])

    def none() -> str:
        if rng.random() < 0.5:
            return place()
        if rng.random() < 0.25:
            return said()
        bad = num(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return rng.choice([
            bad, num(2), num(3), num(4), num(6), num(8), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}",
            f"{num(2)}:{num(2)}", f"{num(3)}.{num(2)}", f"{num(2)}.{num(3)}.{num(3)}", f"commit {hexa(40)}", f"sha256 {hexa(64)}", f"md5: {hexa(32)}", f"sha256:{hexa(64)}",
            f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"order {num(10)}", f"invoice {num(12)}",
            f"v{num(1)}.{num(1)}", f"{rng.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", "@" + "".join(rng.choice("aeinorst") for _ in range(6)), f"{num(1)} @ {num(2)}", f"{num(3)}%", f"({num(2)})",
            f"{num(4)} {num(4)}", f"{num(1)}, {num(1)}, {num(2)} {num(2)}", f"{num(24)}", f"a{num(2)}", f"${num(3)}.{num(2)}", f"{num(4)}-{num(4)}", "the token", "a key", "password:", "call them",
            f"x{luhned(15)}q", f"{hexa(6)}{luhned(12)}{hexa(6)}z",
        ])

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(filler() for _ in range(rng.randint(0, 6))) + rng.choice([" ", "\n", " "])
            kind = rng.choice(["email", "ip", "card", "phone", "secret", "", "", "", "", "", ""])
            value = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret, "": none}[kind]()
            if "\0" in value:  # a cue that isn't part of the span
                cue, value = value.split("\0")
                text += cue
            lead, tail = rng.choice(["", "", "", "(", '"', "<"]), rng.choice(["", "", "", ".", ",", ")", "###", "!!", "$$$"])
            if kind == "secret":
                lead, tail = "", rng.choice(["", "", ".", ",", "###", "!!"])
            if kind:
                text += lead
                inner = value.strip('"') if kind == "secret" else value
                at = len(text) + value.index(inner)
                spans.append((kind, at, at + len(inner)))
                text += value + tail
            else:
                text += value + rng.choice(["", "", ".", ","])
            text += " "
        rows.append((text + filler(), spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """The training table: text, spans array<struct<kind, start, end>>."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


# ---- the field

NEIGHBOURS = (-2, -1, 1, 2)


class Field:
    """Weights of features by label, those of a word's own and those of each of its NEIGHBOURS; transitions
    [labels, labels]; label 0 is O, which also stands before and after a text."""

    def __init__(self, own: dict[str, np.ndarray], near: list[dict[str, np.ndarray]], steps: np.ndarray):
        self.own, self.near, self.steps = own, near, steps

    def tables(self, types: Types, first: int = 0) -> list[np.ndarray]:
        """Scores [types from first on, labels]: of the word, and as a neighbour at each of NEIGHBOURS."""
        none = np.zeros(len(self.steps))
        of = lambda weights, features: sum((weights[f] for f in features if f in weights), none)
        out = [[of(self.own, f) for f in types.own[first:]], *([of(w, f) for f in types.near[first:]] for w in self.near)]
        return [np.array(x, np.float32).reshape(-1, len(none)) for x in out]


def viterbi(scores, steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels [longest, n] of n chains, the longest first. scores(lo, hi) gives [steps, labels, n] for the
    positions lo to hi, so that only the ways back, a byte a label, are held for all positions."""
    n, longest, k = len(lengths), int(lengths[0]) if len(lengths) else 0, len(steps)
    steps = steps.astype(np.float32)
    best, back = np.empty((k, n), np.float32), np.zeros((longest, k, n), np.int8)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains that go on beyond each position
    for lo in range(0, longest, STEPS):
        block = scores(lo, min(longest, lo + STEPS))
        for t in range(lo, min(longest, lo + STEPS)):
            m, here = int(active[t]), block[t - lo]
            if t == 0:
                best[:] = here + steps[0][:, None]
                continue
            if m <= 8:
                through = best[:, None, :m] + steps[:, :, None]
                way = through.argmax(0)
                back[t, :, :m] = way
                best[:, :m] = np.take_along_axis(through, way[None], 0)[0] + here[:, :m]
                continue
            top, way = best[0, :m] + steps[0][:, None], back[t, :, :m]
            for j in range(1, k):
                through = best[j, :m] + steps[j][:, None]
                better = through > top
                np.copyto(top, through, where=better)
                way[better] = j
            best[:, :m] = top + here[:, :m]
    labels, now, columns = np.zeros((longest, n), np.int8), (best + steps[:, :1]).argmax(0), np.arange(n)
    for t in range(longest - 1, -1, -1):
        m = int(active[t])
        labels[t, :m] = now[:m]
        now[:m] = back[t, now[:m], columns[:m]]
    return labels


def _wanted(text: str, starts: np.ndarray, ends: np.ndarray, spans) -> list[int]:
    """The label of each word (places in code points)."""
    out = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        label, before = 0, out[-1] if out else 0
        for kind, a, b in spans:
            if a < e and s < b:
                label = LABELS.index(("I-" if before and LABELS[before][2:] == kind and a < s else "B-") + kind)
        out.append(label)
    return out


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150) -> Field:
    """The field that maximises the likelihood of the rows less a square penalty (Adam, full batch)."""
    types, words, gold, lengths = Types(), [], [], []
    for text, spans in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        own, s, e, _ = types.of(data, np.array([0, len(data)]))
        if len(own):
            place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            words.append(own)
            gold.append(_wanted(text, place[s], place[e], spans))
            lengths.append(len(own))
    order = sorted(range(len(words)), key=lambda i: -lengths[i])
    words, gold, lengths = [words[i] for i in order], [gold[i] for i in order], np.array([lengths[i] for i in order])
    n, longest, k = len(words), int(lengths[0]), len(LABELS)
    seen: list[dict[str, int]] = [{}, {}]
    for w in words:
        for t in w.tolist():
            for held, features in zip(seen, (types.own[t], types.near[t])):
                for f in features:
                    held[f] = held.get(f, 0) + 1
    index = [{f: i for i, f in enumerate(sorted(f for f, c in {**held, "beyond": 2}.items() if c > 1))} for held in seen]
    marks = [np.zeros((len(types.own), len(ix)), np.float32) for ix in index]
    for mark, ix, features in zip(marks, index, (types.own, types.near)):
        for t, own in enumerate(features):
            mark[t, [ix[f] for f in own if f in ix]] = 1
    padded = np.zeros((n, longest + 4), np.int64)
    want, inside = np.zeros((n, longest, k)), np.arange(longest) < lengths[:, None]
    for i, (w, g) in enumerate(zip(words, gold)):
        padded[i, 2 : 2 + len(w)] = w
        want[i, np.arange(len(w)), g] = 1
    moves = np.zeros((k, k))
    for g in gold:
        for a, b in zip([0, *g], [*g, 0]):
            moves[a, b] += 1
    places = (0, *NEIGHBOURS)
    weights = [np.zeros((len(index[min(j, 1)]), k)) for j in range(len(places))] + [np.zeros((k, k))]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

    at = [padded[:, 2 + p : 2 + p + longest] for p in places]
    active = [int((lengths > t).sum()) for t in range(longest)]  # texts that go on beyond each position, the longest first
    for step in range(1, steps + 1):
        s = sum((marks[min(j, 1)] @ weights[j])[at[j]] for j in range(len(places)))
        trans = weights[-1]
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0] + trans[0]
        for t in range(1, longest):
            m = active[t]
            ahead[:m, t] = lse(ahead[:m, t - 1, :, None] + trans, 1) + s[:m, t]
        behind[np.arange(n), lengths - 1] = trans[:, 0]
        for t in range(longest - 2, -1, -1):
            m = active[t + 1]
            behind[:m, t] = lse(trans + (behind[:m, t + 1] + s[:m, t + 1])[:, None, :], 2)
        logz = lse(ahead[:, 0] + behind[:, 0], 1)
        p = np.exp(np.minimum(ahead + behind - logz[:, None, None], 0)) * inside[..., None]
        expected = np.zeros((k, k))
        expected[0] += p[:, 0].sum(0)
        expected[:, 0] += p[np.arange(n), lengths - 1].sum(0)
        for t in range(1, longest):
            on = slice(0, active[t])
            expected += np.exp(ahead[on, t - 1, :, None] + trans + (s[on, t] + behind[on, t])[:, None, :] - logz[on, None, None]).sum(0)
        rest = ((want - p) * inside[..., None])[inside]
        for j, w in enumerate(weights):
            if j < len(places):
                here = at[j][inside]
                order = np.argsort(here, kind="stable")
                met, first = np.unique(here[order], return_index=True)
                g = marks[min(j, 1)][met].T @ np.add.reduceat(rest[order], first, 0)
            else:
                g = moves - expected
            g = g - 0.1 * w
            m, v = state[j]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    named = [{f: w[i] for f, i in index[min(j, 1)].items()} for j, w in enumerate(weights[:-1])]
    return Field(named[0], named[1:], weights[-1])


@cache
def _fitted(rows: tuple) -> Field:
    return fit([(text, list(spans)) for text, spans in rows])


def trained(table: DataFrame) -> Field:
    """A field fitted on MAX_LABELLED rows at most, chosen by hash, of a labelled table (text, spans
    array<struct<kind, start, end>>, places in code points). Rows without text are left out."""
    rows = table.filter("text IS NOT NULL").orderBy(F.xxhash64("text")).limit(MAX_LABELLED).select("text", "spans").collect()
    return _fitted(tuple((r["text"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] or ())) for r in rows))


def _bounds(word: str, kind: str) -> tuple[int, int]:
    """Without the marks around it; a bracket that opens a number stays. Of a credential what stands behind its name."""
    a, b = 0, len(word)
    if kind == "secret":
        bare = word.rstrip(".,;:!?)]}>#*$%&|\"'`\u201d\u00bb")
        b = len(bare) if len(bare) else b
        if name := re.match(r"[A-Za-z][\w.-]*[=:]+(?!//)", word[:b]):
            a = name.end() if name.end() < b else a
        while a < b and word[a] in "\"'`(<[{\u201c\u00ab":
            a += 1
        return a, b
    while a < b and not (word[a].isalnum() or word[a] in "+" or word[a] == "(" and re.match(r"\([0-9]+\)", word[a:])):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] == ")" and re.search(r"\([0-9]+\)$", word[a:b])):
        b -= 1
    return a, b


_FORM = {
    "email": re.compile(r"[^@\s]+@[^@\s]+"), "ip": re.compile(r"[0-9]+(?:[.\[\]()]+[0-9]+){3}"), "card": re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][\x20().0-9/-]+[0-9]"), "secret": re.compile(r"\S{6,}"),
}


def _plausible(kind: str, text: str) -> bool:
    """What a span of a kind looks like at least; the field decides among those."""
    d = len(_digits(text))
    said = {"email": any(c.isalpha() for c in text), "ip": 4 <= d <= 12, "card": 13 <= d <= 19 and luhn(_digits(text)), "phone": 9 <= d <= 15, "secret": True}
    return bool(_FORM[kind].fullmatch(text)) and said[kind]


class Decoder:
    """A field with its score tables for the types seen so far."""

    def __init__(self, field: Field):
        self.field, self.types = field, Types()
        self.tables = field.tables(self.types)

    def _grown(self) -> list[np.ndarray]:
        if (have := len(self.tables[0])) < len(self.types.own):
            self.tables = [np.concatenate(x) for x in zip(self.tables, self.field.tables(self.types, have))]
        return self.tables

    def labelled(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each row with a label other than O: row, starts and ends of its words (bytes in the row), labels."""
        if self.types.forget():
            self.tables = [t[: self.types.fixed] for t in self.tables]
        words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in tb.slices(offsets):
            types, s, e, rows = self.types.of(data, offsets[lo : hi + 1])
            for r in range(hi - lo):
                a, b, base = rows[r], rows[r + 1], offsets[lo + r] - offsets[lo]
                words.append((types[a:b], (s[a:b] - base), (e[a:b] - base)))
        tables, lengths = self._grown(), np.array([len(w[0]) for w in words])
        order = np.argsort(-lengths, kind="stable")
        order, lo = order[lengths[order] > 0], 0
        while lo < len(order):
            hi = min(len(order), lo + TOGETHER)
            while hi > lo + 1 and (hi - lo) * lengths[order[lo]] > GROUP_WORDS:
                hi = lo + (hi - lo + 1) // 2
            group = order[lo:hi]
            longest = lengths[group[0]]
            padded = np.zeros((longest + 4, len(group)), np.int32)
            for j, i in enumerate(group):
                padded[2 : 2 + lengths[i], j] = words[i][0]

            def scores(a: int, b: int) -> np.ndarray:
                out = tables[0][padded[a + 2 : b + 2]]  # noqa: B023
                for table, p in zip(tables[1:], NEIGHBOURS):
                    out += table[padded[a + 2 + p : b + 2 + p]]  # noqa: B023
                return np.ascontiguousarray(out.transpose(0, 2, 1))

            labels = viterbi(scores, self.field.steps, lengths[group])
            for j in np.flatnonzero(labels.any(0)).tolist():
                i = int(group[j])
                yield i, words[i][1], words[i][2], labels[: lengths[i], j]
            lo = hi


def added_spans(decoder: Decoder, data: np.ndarray, offsets: np.ndarray, base: dict[int, list[tuple[str, int, int]]]) -> dict[int, list[tuple[str, int, int]]]:
    """By row the field's spans that touch none of its base spans, by kind, then start (places in code points)."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    for i, starts, ends, labels in decoder.labelled(data, offsets):
        own = data[offsets[i] : offsets[i + 1]]
        place, taken = None, base.get(i, [])
        at = np.flatnonzero(labels).tolist()
        t = 0
        while t < len(at):
            kind, first, last = LABELS[labels[at[t]]][2:], at[t], at[t]
            t += 1
            while t < len(at) and at[t] == last + 1 and LABELS[labels[at[t]]] == f"I-{kind}":
                last, t = at[t], t + 1
            if place is None:
                place = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            word = lambda w: own[starts[w] : ends[w]].tobytes().decode()  # noqa: B023, E731
            a = int(place[starts[first]]) + _bounds(word(first), kind)[0]
            b = int(place[starts[last]]) + _bounds(word(last), kind)[1]
            said = own[starts[first] : ends[last]].tobytes().decode()[a - int(place[starts[first]]) : b - int(place[starts[first]])]
            if a < b and _plausible(kind, said) and not any(x < b and a < y for _, x, y in taken):
                out.setdefault(i, []).append((kind, a, b))
    return {i: sorted(x, key=lambda s: (FIELD_KINDS.index(s[0]), s[1])) for i, x in out.items()}


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_HAS = np.zeros(256, bool)
_HAS[[*range(48, 58), 64]] = True


def _batches(batches: Iterator[pa.RecordBatch], field: Field, text: int, keep: list[int], name: str, redacted: bool) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(field)
    for batch in batches:
        column = batch.column(text)
        data, offsets = tb.column(column)
        marked = np.zeros(len(column), bool)
        for lo, hi in tb.slices(offsets):
            seen = np.concatenate([[0], np.cumsum(_HAS[data[offsets[lo] : offsets[hi]]], dtype=np.int64)])
            marked[lo:hi] = np.diff(seen[offsets[lo : hi + 1] - offsets[lo]]) > 0
        base = {i: base_spans(column[i].as_py()) for i in np.flatnonzero(marked).tolist()}  # every pattern has a digit or @
        more = added_spans(decoder, data, offsets, base)
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        new: dict[int, str] = {}
        for i in sorted(base.keys() | more.keys()):
            every = sorted([(FIELD_KINDS.index(k), s, e, k, True) for k, s, e in base.get(i, [])] + [(FIELD_KINDS.index(k), s, e, k, False) for k, s, e in more.get(i, [])])
            spans[i] = [{"kind": k, "start": s, "end": e, "base": x} for _, s, e, k, x in every]
            if redacted and every:
                new[i] = masked(column[i].as_py(), [(k, s, e) for _, s, e, k, _ in every])
        columns = {batch.schema.names[j]: batch.column(j) for j in keep}
        if redacted:
            columns[batch.schema.names[text]] = pa.array([new.get(i, x) for i, x in enumerate(column.to_pylist())], column.type) if new else column
        else:
            columns[name] = pa.array(spans, _ARROW)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind, in brackets, of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def found(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """All columns of docs and, under name, the spans (kind, start, end, base) of each whole text.

    Starts and ends count code points, ends exclusive; the order is by kind (FIELD_KINDS), then start. A null
    or empty text has no spans. Repeated rows each get theirs; a column of that name gives way; an empty
    table gives an empty table.
    """
    small_batches(docs.sparkSession)
    field, names = trained(labelled_table(docs.sparkSession)), [c for c in docs.columns if c != name]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(name, T.ArrayType(_SPAN))])
    keep = list(range(len(names)))
    return docs.select(*names).mapInArrow(lambda it: _batches(it, field, names.index(text), keep, name, False), schema)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, if there, follows the text.

    A null text stays null. Repeated rows are each redacted; an empty table gives an empty table; all other
    columns, whatever their names, stay as they are.
    """
    small_batches(docs.sparkSession)
    field, names = trained(labelled_table(docs.sparkSession)), docs.columns
    out = docs.mapInArrow(lambda it: _batches(it, field, names.index(text), list(range(len(names))), "", True), docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = found(docs).select("doc_id", "spans")
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
