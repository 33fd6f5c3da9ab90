"""Values worked out by hand."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import special
from parley.functions import text as tx
from parley.operators import generation, inference, labels, metrics, quality, vectors
from parley.operators import turns as tn
from parley.sources import conversations as src


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    return src.table_turns(spark, sf_dir).filter("split(conv_id, '/')[1] >= 9000").cache()


def of(df, no):
    return df.filter(F.col("conv_id").endswith(f"/{no}"))


def test_metrics(turns):
    r = of(metrics.conversation_metrics(turns), 9001).first()
    got = [r.n_turns, r.mean_words, r.median_words, r.sd_words, r.oh_per_100, r.okay_per_100, r.uh_huh_per_100, r.short_share, r.backchannel_ratio, r.oh_contingency, r.self_repair, r.closing_order, r.sycophancy_per_100, r.sycophancy_share, r.opener_share]
    want = [10, 4.7, 6.0, 3.093003, 4.255319, 6.382979, 2.127660, 0.4, 0.25, 0.5, 6.382979, 1, 6.382979, 0.1, 0]
    assert got == pytest.approx(want, abs=1e-5)


def test_labels(turns):
    rows = of(labels.labelled(turns), 9002).orderBy("turn_index").collect()
    got = ["".join(k for k, v in labels.LABELS.items() if r[v]) for r in rows]
    assert got == ["ABC", "BCD", "H", "BEG", "B", "EH"]


def test_topic_codes(turns):
    codes = [r.topic_code[:2] for r in of(labels.labelled(turns), 9004).orderBy("turn_index").collect()]
    assert codes == ["F1", "F1", "F3", "F4", "F4", "F3", "F3"]


def test_quality(turns):
    q = of(quality.conversation_quality(turns), 9003)
    r = q.first()
    assert (r.n_turns, r.fragments, r.loops, r.drift, r.leaks, r.tells, r.median_words, r.closed_naturally) == (10, 2, 1, 2, 1, 1, 4.5, False)
    v = quality.verdicts(q).first()
    assert (v.bad, v.verdict) == (7, "BAD")


def test_drift_letters(spark):
    """Letters without LATIN in their names: ordinal signs and modifier letters are, accented ones aren't."""
    texts = ["la 1ª vez", "déjà Ünal ß", "Kelvin \u212a", "x\u02b0", "Привет", "１２ ＡＢ", "plain 12 !?", "漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.d for r in df.orderBy("i").select(tx.is_drift(F.col("t")).alias("d")).collect()] == [True, False, True, True, True, False, False, True]


def test_title(spark):
    texts = ["  rock'n'roll do-it-yourself 2nd CAR ", "élan vital", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.t for r in df.orderBy("i").select(tx.title_case(F.col("t")).alias("t")).collect()] == [t.strip().title() for t in texts]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, -1.0], [-4.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(tx.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([math.sqrt(0.5), 0, -1])


def test_numbers(spark):
    df = spark.createDataFrame(list(enumerate(["1.5", "", "nan", "x", None, "-2"])), "i int, t string")
    assert [r.v for r in df.orderBy("i").select(tx.to_float(F.col("t")).alias("v")).collect()] == [1.5, None, None, None, None, -2.0]


def test_comparison(turns):
    """Body turns under one list for both sides; the test lists count a Partner as a leak, the usual ones don't."""
    c2 = turns.filter("conv_id IN ('C2-P1/9008', 'C1-P0/9004', 'SB/9005')")
    old = c2.filter("conv_id <> 'SB/9005' AND turn_index < 3")
    got = {r.conv_id: r for r in quality.compared(c2, old, spanish=lx.DRIFT_WORDS_TEST, leak=lx.LEAK_TEST, foreign_script=False).collect()}
    r = got["C2-P1/9008"]
    assert [r.n_turns_new, r.median_words_new, r.leaks_new, r.n_turns_old, r.median_words_old, r.leaks_old] == [5, 5, 1, 1, 5, 0]
    assert (got["C1-P0/9004"].n_turns_new, got["C1-P0/9004"].n_turns_old) == (7, 3)
    assert got["SB/9005"].n_turns_new == 3 and got["SB/9005"].n_turns_old is None
    assert of(quality.conversation_quality(turns), 9008).first().leaks == 0
    f = of(quality.final_check(turns), 9003).first()
    assert (f.n, f.median_words, f.loops, f.spanish, f.leaks, f.fragments, f.ended_early) == (10, 4.5, 1, 1, 1, 2, True)


def test_matched_topics(spark):
    """Groups of one and texts without a topic are left out."""
    members = spark.createDataFrame([(1, "a", "SB"), (2, "a", "SB"), (3, "a", "C1"), (4, "a", "C1"), (5, "b", "C1"), (6, "b", "C1"), (7, "a", "C2")], "id int, topic string, condition string")
    v = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (3, "x", 1.0), (4, "x", 1.0), (5, "x", 1.0), (6, "y", 1.0), (7, "x", 1.0)], "id int, term string, w double")
    groups = ["topic", "condition"]
    by = vectors.with_nearest(vectors.dispersion(members, v, groups, 2), vectors.nearest(members, v, groups), groups)
    got = {(r.topic, r.condition): r.CED for r in by.collect()}
    assert got == pytest.approx({("a", "SB"): 1 - math.sqrt(0.5), ("a", "C1"): 0, ("b", "C1"): 1 - math.sqrt(0.5)})
    matched = {r.condition: (r.n_topics, r.CED, r.mean_nn_distance) for r in vectors.matched_topics(by).collect()}
    assert set(matched) == {"SB", "C1"} and matched["C1"] == pytest.approx((1, 0, 0)) and matched["SB"] == pytest.approx((1, 1 - math.sqrt(0.5), 1))


def test_nearest_in_blocks(spark, monkeypatch):
    """Groups of several chunks, members without terms, negative products, against all pairs."""
    import numpy as np

    monkeypatch.setattr(vectors, "CHUNK", 4)
    monkeypatch.setattr(vectors, "TILE", 3)
    rng = np.random.default_rng(6)
    dense = {i: np.where(rng.random(9) < 0.5, rng.normal(size=9), 0) for i in range(40)}
    for i in (3, 17, 18):
        dense[i] = np.zeros(9)
    group = {i: "big" if i < 25 else "small" if i < 39 else "one" for i in dense}
    members = spark.createDataFrame([(i, g) for i, g in group.items()], "id long, g string")
    v = spark.createDataFrame([(i, f"t{j}", float(w)) for i, x in dense.items() for j, w in enumerate(x) if w], "id long, term string, w double")
    got = {r.id: r.nn_distance for r in vectors.nearest(members, v, ["g"]).collect()}
    want = {i: 1 - max(float(dense[i] @ dense[j]) for j in dense if j != i and group[j] == group[i]) for i in dense if group[i] != "one"}
    assert got == pytest.approx(want)


def test_topics_need_names(spark, sf_dir):
    from parley.plans import analysis

    topics = {(r.topic, r.condition) for r in analysis.ced_by_topic(spark, sf_dir).collect()}
    assert ("topic1", "SB") in topics and ("topic1", "C2-P1") in topics and not any(t.strip() == "" for t, _ in topics)
    assert {r.condition for r in analysis.ced_topic_matched(spark, sf_dir).collect()} >= {"SB", "C2-P1"}


def test_cut_transcripts(turns):
    rows = of(turns, 9006)
    whole = tn.joined_text(rows, "t", "\n", labels=True).first().t
    assert whole.startswith("A: So Maria") and tn.joined_text(rows, "t", "\n", labels=True, max_chars=20).first().t == whole[:20]


def test_around_generation(spark):
    ids = spark.createDataFrame([(3, 0), (9, 1), (1, 2)], "conversation_no long, place int")
    known = spark.createDataFrame([(1, "t"), (3, "u")], "conversation_no long, topic string")
    assert sorted((r.conversation_no, r.place, r.topic) for r in generation.chosen(ids, known).collect()) == [(1, 2, "t"), (3, 0, "u")]
    rows = spark.range(4).select(generation.next_speaker(F.col("id")).alias("s"))
    assert [r.s for r in rows.collect()] == ["ParticipantA", "ParticipantB"] * 2
    replies = spark.createDataFrame([(1, True), (1, False), (1, True), (2, False)], "conversation_no long, ran_past boolean")
    assert sorted(map(tuple, generation.emissions(replies).collect())) == [(1, 2), (2, 0)]


def test_few_shot_skips(spark):
    turns = spark.createDataFrame([(c, t, "AB"[t % 2], f"{c}.{t}") for c, n in ((1, 9), (2, 3), (3, 8), (4, 8)) for t in range(n)], "conversation_no long, turn_index long, speaker string, text string")
    files = turns.select("conversation_no", F.format_string("f%02d", "conversation_no").alias("file")).distinct()
    for skip, want in ((0, "1"), (1, "3"), (3, "4"), (4, None)):
        got = generation.few_shot(turns, files, skip=skip, n_turns=2).first().excerpt
        assert got == (f"ParticipantA: {want}.0\nParticipantB: {want}.1" if want else ""), skip


def test_embedder_choice():
    class Model:
        name = "model"

    def broken():
        raise OSError("no weights")

    assert vectors.build_embedder().name == vectors.build_embedder("tfidf", Model).name == vectors.build_embedder("auto", broken).name == "tfidf"
    assert vectors.build_embedder("model", Model).name == vectors.build_embedder("auto", Model).name == "model"
    with pytest.raises(OSError):
        vectors.build_embedder("model", broken)
    with pytest.raises(ValueError):
        vectors.build_embedder("model")


def test_markup_and_merge(spark):
    rows = spark.createDataFrame([(1, 1, "A", "hi"), (1, 2, "A", "x"), (1, 3, "B", "<beep>"), (1, 4, "A", "z"), (2, 1, None, "a"), (2, 2, None, "b")], "c long, i long, s string, t string")
    got = sorted((r.c, r.turn_index, r.speaker, r.text) for r in tn.merged(rows, "c", ["i"], "s", "t").collect())
    assert got == [(1, 0, "A", "hi x z"), (2, 0, None, "a b")]


def test_natural_end_is_the_loop(spark):
    """The closed form against stepping through every farewell sequence."""

    def loop(flags):
        n, ending = 2, False
        for i, f in enumerate(flags):
            n += 1
            if ending or (f and i > 0 and flags[i - 1]):
                break
            ending = f
        return n

    cases = [c for k in range(1, 8) for c in itertools.product([False, True], repeat=k)]
    rows = [(i, t, "bye" if f else "word") for i, c in enumerate(cases) for t, f in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, text string")
    got = {r.conv_id: r.n_kept for r in tn.natural_end(df, tx.has(F.col("text"), lx.CLOSING)).collect()}
    assert got == {i: loop(c) for i, c in enumerate(cases)}


def test_tolerant_lines(spark):
    raw = "PArTiCIpAnT b: Hi  \r\nParticipantsA:  So\u2028participant A:\rNote: no"
    r = spark.createDataFrame([(raw,)], "raw string").select(tn.parsed(F.col("raw"), "tolerant").alias("t")).first()
    assert [tuple(t) for t in r.t] == [("PArTiCIpAnT b", "Hi  "), ("ParticipantsA", "So"), ("participant A", "")]


def test_unicode_boundaries(spark):
    r = spark.createDataFrame([("déjà Déjà vu oh a b",)], "t string").select(tx.count(F.col("t"), lx.REPAIR_REPEAT).alias("n"), tx.n_words(F.col("t")).alias("w")).first()
    assert (r.n, r.w) == (1, 6)


def test_vectors(spark):
    docs = spark.createDataFrame([("1", "oh oh car"), ("2", "car dog"), ("3", "dog dog dog")], "id string, text string")
    model = vectors.Tfidf().fit(docs)
    assert [r.term for r in model.vocabulary.orderBy(F.desc("df"), F.desc("tf"), F.desc("term")).collect()] == ["dog", "car", "oh"]
    rows = {(r.id, r.term): r.w for r in model.encode(docs).collect()}
    assert rows == pytest.approx({("1", "car"): 0.355432468, ("1", "oh"): 0.934701964, ("2", "dog"): math.sqrt(0.5), ("2", "car"): math.sqrt(0.5), ("3", "dog"): 1.0})
    members = docs.select("id", F.lit("g").alias("g"))
    d = vectors.dispersion(members, model.encode(docs), ["g"]).first()
    assert [d.CED, d.min_distance, d.max_distance] == pytest.approx([0.260866049, 0.116788197, 0.435677973])
    assert sorted(r.nn_distance for r in vectors.nearest(members, model.encode(docs), ["g"]).collect()) == pytest.approx([0.292893219, 0.292893219, 0.748671292])


def test_statistics(spark):
    groups = {"a": [10, 12, 14, 16, 18], "b": [8, 9, 9, 11, 13], "c": [5, 7, 8, 9, 12]}
    df = spark.createDataFrame([("p", g, i, float(v)) for i, (g, vs) in enumerate(groups.items()) for v in vs], "p string, g string, i int, v double")
    ab = df.filter("g <> 'c'")
    w = inference.welch(ab, "g", "v", "b").first()
    assert [w.t, w.df, w.d] == pytest.approx([2.390457219, 6.758620690, 1.511857892])
    assert inference.mann_whitney(ab, "g", "v", "b").first().U == 22
    assert inference.kruskal(df, "g", "v", ["p"]).first().H == pytest.approx(7.293140794)
    assert inference.spearman(df, "i", "v", ["p"]).first().rho == pytest.approx(-0.712510688)
    assert inference.omnibus(df, "g", "v", "c").first().F == pytest.approx(6.386473430)


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, abs=1e-9)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert special.f_upper(4.0, 2, 10) == pytest.approx((1 + 2 * 4.0 / 10) ** -5, abs=1e-12)
    assert special.chi2_upper(5.0, 2) == pytest.approx(math.exp(-2.5), abs=1e-12)
    assert special.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    us = [sum(x > y for x in own for y in set(range(7)) - set(own)) for own in itertools.combinations(range(7), 3)]
    for u in range(13):
        high = max(u, 12 - u)
        assert special.mann_whitney(u, 3, 4, 0) == pytest.approx(min(1, 2 * sum(x >= high for x in us) / len(us)))


def test_mixed_model_is_reml(spark):
    """Folded statistics give the likelihood of the dense matrices at the optimum."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(g, g % 2, int(t >= 3), float(2 + g % 2 + 0.5 * (t >= 3) + u + rng.normal())) for g in range(24) for u in [rng.normal() * 2] for t in range(6)]
    df = spark.createDataFrame(rows, "g long, a int, b int, y double")
    out = inference.mixed_model(df, "y", "g", ["a", "b"])
    y, x = np.array([r[3] for r in rows]), np.array([[1, r[1], r[2], r[1] * r[2]] for r in rows], float)
    z = np.equal.outer([r[0] for r in rows], [r[0] for r in rows]).astype(float)

    def value(gamma):
        v = np.eye(len(y)) + gamma * z
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        beta = np.linalg.solve(a, x.T @ vi @ y)
        r = y - x @ beta
        s2 = r @ vi @ r / (len(y) - 4)
        return (len(y) - 4) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, s2

    gamma = out[0]["group_var"] / out[0]["residual_var"]
    best, beta, s2 = value(gamma)
    assert best <= min(value(g)[0] for g in (gamma * 0.97, gamma * 1.03)) + 1e-9
    assert [r["coef"] for r in out] == pytest.approx(list(beta), abs=1e-6)
    assert out[0]["residual_var"] == pytest.approx(s2)


def test_mixed_models_by_condition(spark):
    """Each condition's model is the one over its rows and the baseline's alone."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(f"{c}/{g}", c, int(t >= 3), float(i + 0.5 * (t >= 3) + u + rng.normal())) for i, c in enumerate(("SB", "C1", "C2")) for g in range(9 + i) for u in [rng.normal() * 2] for t in range(4 + g % 3)]
    df = spark.createDataFrame(rows, "g string, c string, later int, y double")
    for first in (0, 1):
        got = inference.mixed_models(df, "y", "g", "own", ["later"], "c", "SB", first)
        assert [r["c"] for r in got] == ["C1"] * 4 + ["C2"] * 4
        for c in ("C1", "C2"):
            own = df.filter(F.col("c").isin("SB", c)).withColumn("own", (F.col("c") == ("SB" if first else c)).cast("int"))
            for a, b in zip([r for r in got if r["c"] == c], inference.mixed_model(own, "y", "g", ["own", "later"])):
                assert a["term"] == b["term"] and [a[k] for k in ("coef", "se", "p", "group_var")] == pytest.approx([b[k] for k in ("coef", "se", "p", "group_var")], rel=1e-6)


def test_mixed_model_does_not_hang_on_last_digits():
    """Sums that differ in their last digits, as another order of rows gives them, leave nine digits of the model the same."""
    import numpy as np

    rng = np.random.default_rng(3)
    folded = []
    for g in range(12):  # one group a pattern
        n = [0, 0, 0, 0]
        n[g % 2], n[g % 2 + 2] = 3 + g % 3, 2 + g // 4
        y = [rng.normal(g % 2 + 0.5 * (c > 1) + u, size=k) for u in [rng.normal() * 2] for c, k in enumerate(n)]
        s = [float(x.sum()) for x in y]
        folded.append({"m": 1, "yy": float(sum((x * x).sum() for x in y))} | {f"n{c}": n[c] for c in range(4)} | {f"S{c}": s[c] for c in range(4)} | {f"P{a}_{b}": s[a] * s[b] for a in range(4) for b in range(a, 4)})
    want = inference._reml(folded, ["a", "b"])
    assert want[0]["group_var"] > 0.1
    for step in (1e-15, -1e-15, 3e-15):
        other = [{k: v * (1 + step * (i % 2)) if k[0] in "ySP" else v for k, v in r.items()} for i, r in enumerate(folded)]
        for a, b in zip(inference._reml(other[::-1], ["a", "b"]), want):
            assert [a[k] for k in ("coef", "se", "p", "group_var")] == pytest.approx([b[k] for k in ("coef", "se", "p", "group_var")], rel=1e-9)


def test_p_values_by_hand(spark):
    """Two groups of three: Welch's p by its integral, the exact rank test, and the equal-variance t of the regression."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    t = 3 / math.sqrt(2 / 3)  # on 4 degrees of freedom, as the variances are equal
    p = 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))
    assert inference.welch(df, "g", "v", "b").first().p == pytest.approx(p, abs=1e-9)
    assert inference.mann_whitney(df, "g", "v", "b").first().p == pytest.approx(0.1)
    assert {r.g: r.p for r in inference.omnibus(df, "g", "v", "b").collect()}["a"] == pytest.approx(p, abs=1e-9)


def test_projection(spark):
    """The first axes of a plane in space, up to sign."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ np.array([[3.0, 0, 1], [0, 1, -0.5]]) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([[r.pc1, r.pc2] for r in vectors.projection(df).orderBy("id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_agent_messages(spark):
    meta = [(1, "PETS", " x ", "910301", "FEMALE", "m", "1950", "bad", "3", "7")]
    names = "conversation_no long, topic_description string, prompt string, talk_day string, from_caller_sex string, to_caller_sex string, from_caller_birth_year string, to_caller_birth_year string, from_caller_education string, to_caller_education string"
    p = generation.personas(spark.createDataFrame(meta, names))
    r = p.first()
    assert tuple(r.persona_a) == ("ParticipantA", "woman", 41, "a college degree") and tuple(r.persona_b) == ("ParticipantB", "man", 40, "an unspecified education")
    history = F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit(t).alias("text")) for s, t in (("ParticipantB", "hey"), ("ParticipantA", "yo"), ("ParticipantB", "so"))])
    rows = p.withColumn("speaker", F.lit("ParticipantB")).withColumn("history", history)
    got = [(m.role, m.content) for m in generation.prompts(rows, "P0", "AG").first().messages]
    assert [r for r, _ in got] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert got[1][1] == generation.UNDERWAY and got[-1][1] == generation.QUIET
    empty = rows.withColumn("history", F.filter("history", lambda h: F.lit(False)))
    assert [m.content for m in generation.prompts(empty, "P1", "AG").first().messages][1:] == [generation.CONNECTS]
    out = generation.generated(generation.prompts(rows, "P2", "C2", "A: x"), lambda m: m.map(lambda _: "ParticipantB: Well. ParticipantA: No")).first()
    assert (out.turn, out.ran_past) == ("Well.", True)


def test_sampled_anchoring(spark, sf_dir):
    """A sample leaves out no turn that the whole pool has; drawn to the full, it is the whole pool."""
    rows = src.table_turns(spark, sf_dir).cache()
    value = lambda **how: {(r.conv_id, r.turn_index): r.cas for r in vectors.anchoring(rows, **how).collect() if r.cas is not None}
    exact = value()
    assert value(k=5, seed=7).keys() == exact.keys()
    assert value(k=10**6, seed=7) == pytest.approx(exact)
    # Topic a has two conversations, the others one each, and one has none.
    topics = {1: "a", 2: "A ", 3: "b", 4: "c", 5: ""}
    turns = [(str(i), j, t, f"word{i} common w{j} w{(i * j) % 3}") for i, t in topics.items() for j in range(7 if t.lower().strip() == "a" else 3)]
    rows = spark.createDataFrame(turns, "conv_id string, turn_index int, topic string, text string")
    exact = value()
    assert len(exact) == 18 and value(k=5, seed=7).keys() == exact.keys()
    assert value(k=50, seed=7) == pytest.approx(exact)
