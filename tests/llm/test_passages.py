"""op10: every repeated passage of 50 words is found wherever it stands; near lines; clean documents."""

import random
import time
from collections import Counter

import numpy as np

from parley.llm import passages, spread
from parley.llm import textbuf as tb
from parley.llm.registry import queries


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in passages.repeated(docs).collect()}


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_passages(spark):
    rng = random.Random(3)
    texts, planted = {}, set()
    for i in range(40):  # a passage of 50 to 120 words in the middle of other lines
        p = fresh(rng, rng.randint(50, 120))
        for doc in (2 * i, 2 * i + 1):
            texts[doc] = " ".join(fresh(rng, rng.randint(0, 60)) + p + fresh(rng, rng.randint(0, 60)))
            planted.add(doc)
    line = fresh(rng, 120)  # lines that differ in one word
    near = line[:60] + ["other"] + line[61:]
    texts |= {200: " ".join(line), 201: "Intro.\n" + " ".join(near) + "\nEnd."}
    short = fresh(rng, 12)
    for i in range(300, 340):
        texts[i] = " ".join(fresh(rng, 80) + short + fresh(rng, 80))
    for i in range(400, 403):
        texts[i] = "word " * 0 + " ".join(line[::-1])
    got = found(spark, texts)
    assert set(got) == planted | {200, 201, 400, 401, 402}
    assert got[200].clusters == got[201].clusters or set(got[200].clusters) & set(got[201].clusters)
    assert got[400].n_removed == 0 and got[401].n_removed == got[402].n_removed > 0
    assert all(set(got[2 * i].clusters) & set(got[2 * i + 1].clusters) for i in range(40))


def test_family(spark):
    """Copies of a line, each with one word changed: most are far from each other, all are near the original."""
    rng = random.Random(5)
    line = fresh(rng, 60)
    texts = {0: " ".join(line)}
    for i in range(1, 1001):
        at = rng.randrange(60)
        texts[i] = " ".join(line[:at] + fresh(rng, 1) + line[at + 1 :])
    got = found(spark, texts)
    assert max(Counter(c for r in got.values() for c in r.clusters).values()) == 1001


def plainly(texts, across=False):
    """By document the covered words, those of them to remove, and the clusters as sets of places: all pairs of lines and all
    pairs of windows compared by the Jaccard of their shingle sets; windows of a text that open within two words of
    each other are one place, and those of hardly any shingles are compared as they are."""
    lines, windows = {}, {}
    for i, text in texts.items():
        place = 0
        for line in (text or "").split("\n"):
            w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in line).replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
            if len(w) >= 26:
                lines[i, place, len(w)] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            place += len(w)
        data = np.frombuffer((text or "").encode(), np.uint8)
        h = tb.words(data, np.array([0, len(data)]))[0]
        g = passages._shingles(h).tolist()
        opens = {min(range(j, j + 25), key=lambda p: (g[p], p)) for j in range(len(g) - 24)}
        for at in opens:
            if at + 26 <= len(h):
                windows[i, at, 26] = tuple(g[at : at + 22])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    holding, seen, later = {}, {}, set()
    for p, a in sorted(windows.items()):
        own = set(a)
        if len(own) < 18:  # of hardly any shingles: only equal ones meet
            parent_of = seen.setdefault(a, p)
            if parent_of != p:
                later.add(p)
                parent[find(("w", *p))] = find(("w", *parent_of))
            continue
        for q, c in Counter(q for x in own for q in holding.get(x, ())).items():
            if 100 * c >= 80 * (len(own) + len(set(windows[q])) - c) and not (p[0] == q[0] and abs(p[1] - q[1]) <= 2):
                later.add(p)
                parent[find(("w", *p))] = find(("w", *q))
        for x in own:
            holding.setdefault(x, []).append(p)
    every = list(lines.items())
    for n, (p, a) in enumerate(every):
        find(("l", *p))
        for q, b in every[:n]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    parent[find(("l", *p))] = find(("l", *q))
    clusters = {}
    for x in list(parent):
        clusters.setdefault(find(x), []).append((*x[1:], x[0]))
    repeated, removed = {}, {}
    clusters = [sorted(c) for c in clusters.values() if len(c) > 1 and (not across or len({m[0] for m in c}) > 1)]
    for c in clusters:
        for i, at, n, kind in c:
            repeated.setdefault(i, set()).update(range(at, at + n))
            if (i, at, n) in later if kind == "w" else (i, at) != c[0][:2]:
                removed.setdefault(i, set()).update(range(at, at + n))
    return repeated, removed, clusters


def same_as_plain(got, texts, across=False):
    repeated, removed, clusters = plainly(texts, across)
    cells = lambda spans: {w for s in spans for w in range(s.start, s.end)}
    assert {i: cells(r.repeated) for i, r in got.items()} == repeated
    assert {i: cells(r.removed) for i, r in got.items() if r.removed} == removed
    assert all((r.n_repeated, r.n_removed) == (len(cells(r.repeated)), len(cells(r.removed))) for r in got.values())
    by = {}
    for i, r in got.items():
        for c in r.clusters:
            by.setdefault(c, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(sorted({m[0] for m in c}) for c in clusters)


def test_documents_plainly(spark, sf_dir):
    """Spans, removals and clusters of whole documents against all pairs."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    same_as_plain({r.doc_id: r for r in queries()["op10_passages"](spark, sf_dir).collect()}, texts)


def test_within_and_across(spark, monkeypatch):
    """Passages that one document repeats, hot ones dealt to several tasks, changes in the last words."""
    monkeypatch.setattr(spread, "HOT_ROWS", 3)
    rng = random.Random(9)
    own, hot, edge = fresh(rng, 60), fresh(rng, 70), fresh(rng, 26)
    texts = {0: " ".join(fresh(rng, 40) + own + fresh(rng, 40) + own)}
    for i in range(1, 30):
        texts[i] = " ".join(fresh(rng, 30) + hot + fresh(rng, 30))
    for i in range(40, 44):
        texts[i] = " ".join(edge[:25] + fresh(rng, 1)) + "\n" + " ".join(fresh(rng, 40))
    for across in (True, False):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r for r in passages.repeated(docs, across=across).collect()}
        assert set(got) == set(range(1, 30)) | {40, 41, 42, 43} | (set() if across else {0})
        same_as_plain(got, texts, across)


def test_windows(spark):
    """34 words that pairs of texts share, and a word or two at their ends changed: every near pair of windows is found."""
    rng = random.Random(13)
    texts = {}
    for i in range(400):
        p = fresh(rng, 34)
        for doc in (2 * i, 2 * i + 1):
            q = list(p)
            if i % 4 == doc % 2:
                q[0 if i % 8 < 4 else -1] = fresh(rng, 1)[0]
            texts[doc] = " ".join(fresh(rng, rng.randint(0, 40)) + q + fresh(rng, rng.randint(0, 40)))
    got = found(spark, texts)
    assert len(got) > 400
    same_as_plain(got, texts)


def test_hardly_any_shingles(spark):
    """Windows of few different shingles: equal ones meet, others don't by a run that proves nothing."""
    rng = random.Random(14)
    tail = lambda: fresh(rng, 40)
    texts = {i: " ".join(["la"] * n + tail()) for i, n in enumerate((0, 10, 30, 60, 61, 200))} | {9: "la " * 100_000}
    got = found(spark, texts)
    assert set(got) >= {3, 4, 5, 9} and not set(got) & {0, 1}


def test_many_spans(spark):
    """32,000 repeats in one text, apart from each other."""
    rng = random.Random(15)
    line = " ".join(fresh(rng, 30))
    texts = {1: "\n".join(f"{line}\n{' '.join(fresh(rng, 8))}" for _ in range(32_000)), 2: line}
    began = time.time()
    got = found(spark, texts)
    assert len(got[1].repeated) == 32_000 and len(got[1].removed) >= 31_999 and got[2].n_removed == 30
    print("seconds", time.time() - began)


def test_recall(spark):
    """Pairs of lines whose Jaccard is 0.80 to 0.85: at least 0.99 of them meet."""
    rng = random.Random(11)
    texts, pairs = {}, 0
    while pairs < 600:
        a = fresh(rng, rng.randint(50, 120))
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = fresh(rng, 1)[0]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            texts[2 * pairs], texts[2 * pairs + 1] = " ".join(a), " ".join(b)
            pairs += 1
    got = found(spark, texts)
    met = sum(bool(2 * i in got and 2 * i + 1 in got and {s.end - s.start for s in got[2 * i].repeated} & {len(texts[2 * i].split())}) for i in range(pairs))
    print("recall of near lines", met / pairs)
    assert met / pairs >= 0.99


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    words = {i: t.lower().split() for i, t in texts.items()}
    held = {}
    for i, w in words.items():
        for j in range(len(w) - 49):
            held.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    need = {i for at in held.values() if len(at) > 1 for i, _ in at}
    got = {r.doc_id for r in queries()["op10_passages"](spark, sf_dir).collect()}
    assert need <= got


def test_odd_rows(spark):
    rng = random.Random(4)
    long = " ".join(fresh(rng, 60_000))
    texts = {1: None, 2: "", 3: "a b c", 4: long, 5: long + " x", 6: "y" * 3_000_000, 7: " \n " * 100}
    got = found(spark, texts)
    assert set(got) == {4, 5} and got[4].n_removed == 0 and got[5].n_removed > 59_000
    p = " ".join(fresh(rng, 60))
    docs = spark.createDataFrame([(None, p, 1), (None, p, 1), (8, p, 1), (8, p, 1)], "doc_id long, text string, clusters int")
    assert [r.doc_id for r in passages.repeated(docs).collect()] == [8]
    assert passages.repeated(docs.limit(0)).count() == 0
