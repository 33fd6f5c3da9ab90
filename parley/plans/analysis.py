"""Queries over vectors, tests and models, and what surrounds generation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import generation as gen
from parley.operators import inference, labels, metrics, vectors
from parley.operators.working import kept
from parley.plans import dialogue
from parley.sources import conversations as src
from parley.sources import sinks
from parley.sources.conversations import TURNS_SQL, table_turns
from parley.streaming import files as stream

#: Sums of products come in any order: results that may be 0 are rounded here and in the oracle.
DIGITS = 9


def _rounded(df):
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- vectors


def _texts(spark, sf_dir):
    return table_turns(spark, sf_dir).select(F.struct("conv_id", "turn_index").alias("id"), "text")


def tfidf(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return vectors.Tfidf().fit(texts).encode(texts).select("id.*", "term", "w")


def tfidf_vocabulary(spark, sf_dir):
    return vectors.Tfidf().fit(_texts(spark, sf_dir)).vocabulary


def _members(spark, sf_dir, embedder=None):
    turns = table_turns(spark, sf_dir)
    v = vectors.conversation_vectors(turns, embedder).withColumnRenamed("conv_id", "id")
    v = kept(v)  # used four times
    return turns.select(F.col("conv_id").alias("id"), "condition", "topic").distinct(), v


def _ced(spark, sf_dir, groups, least=1, embedder=None):
    """Conversations without a topic are in no group by topic."""
    members, v = _members(spark, sf_dir, embedder)
    if "topic" in groups:
        members = members.filter("trim(topic) <> ''")
    members = members.select("id", *groups)
    return vectors.with_nearest(vectors.dispersion(members, v, groups, least), vectors.nearest(members, v, groups), groups)


def ced_by_condition(spark, sf_dir):
    """With what the condition stands for."""
    ced = _rounded(_ced(spark, sf_dir, ["condition"]))
    names = table_turns(spark, sf_dir).select("condition", labels.source_of(F.col("condition")).alias("source"), "architecture", "prompt_level").distinct()
    return ced.join(F.broadcast(names), "condition")  # a row a condition


def _given(spark, sf_dir):
    """A vector of the embeddings table for each text, as if a model had made it."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    key = F.element_at(F.split("conv_id", "/"), -1).cast("long") * 64 + F.col("turn_index")
    texts = table_turns(spark, sf_dir).groupBy("text").agg(F.min(key).alias("key"))
    texts = texts.crossJoin(F.broadcast(e.agg(F.count("*").alias("n"))))  # one row
    return vectors.Given(texts.join(e.withColumnRenamed("embedding", "v"), F.col("vec_id") == F.col("key") % F.col("n")))


def ced_given(spark, sf_dir):
    """Dispersion of conditions on given vectors of the turns."""
    return _rounded(_ced(spark, sf_dir, ["condition"], embedder=_given(spark, sf_dir)))


def cas_given(spark, sf_dir):
    """Anchoring of turns on given vectors."""
    return _rounded(vectors.anchoring(table_turns(spark, sf_dir), _given(spark, sf_dir)))


def words_chart(spark, sf_dir):
    return _rounded(metrics.words_chart(_by_conversation(spark, sf_dir)))


def ced_by_topic(spark, sf_dir):
    return _rounded(_ced(spark, sf_dir, ["topic", "condition"], least=2))


def ced_topic_matched(spark, sf_dir):
    return _rounded(vectors.matched_topics(_ced(spark, sf_dir, ["topic", "condition"], least=2)))


def ced_nn(spark, sf_dir):
    members, v = _members(spark, sf_dir)
    return _rounded(vectors.nearest(members.select("id", "condition"), v, ["condition"]))


def ced_concat(spark, sf_dir):
    turns = table_turns(spark, sf_dir)
    members = turns.select(F.col("conv_id").alias("id"), "condition").distinct()
    v = vectors.conversation_vectors(turns, mode="concat").withColumnRenamed("conv_id", "id")
    return _rounded(vectors.dispersion(members, v, ["condition"]))


def group_social(spark, sf_dir):
    """Group means with anchoring beside the label indices."""
    turns = table_turns(spark, sf_dir)
    indices = labels.conversation_indices(labels.labelled(turns)).join(vectors.cas_by_conversation(vectors.anchoring(turns)), "conv_id", "left")
    return _rounded(labels.group_indices(indices))


def ced_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    v, members = vectors.to_sparse(e), e.select("id", "label")
    return _rounded(vectors.dispersion(members, v, ["label"]))


def nn_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return _rounded(vectors.nearest(e.select("id", "label"), vectors.to_sparse(e), ["label"]).withColumnRenamed("id", "vec_id"))


def centre_cosine(spark, sf_dir):
    """The cosine of each vector with the mean of its label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return _rounded(e.join(F.broadcast(centre), "label").select("vec_id", "label", tx.cosine(F.col("v"), F.col("c")).alias("cosine")))  # a row a label


def cas_exact(spark, sf_dir):
    return _rounded(vectors.anchoring(table_turns(spark, sf_dir)))


def cas_sampled(spark, sf_dir):
    return vectors.anchoring(table_turns(spark, sf_dir), k=5, seed=7)


def cas_conversations(spark, sf_dir):
    return _rounded(vectors.cas_by_conversation(cas_exact(spark, sf_dir)))


def pca(spark, sf_dir):
    return vectors.projection(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


# ---- tests and models


def _by_conversation(spark, sf_dir):
    return metrics.conversation_table(metrics.tidy(table_turns(spark, sf_dir)))


def tidy_rows(spark, sf_dir):
    return metrics.tidy(table_turns(spark, sf_dir)).select("conv_id", "turn_index", "corpus", "n_turns", "section", "words", *lx.MARKERS)


def welch(spark, sf_dir):
    return inference.welch(_by_conversation(spark, sf_dir), "condition", "words", "SB").drop("p")


def mann_whitney(spark, sf_dir):
    rows = _by_conversation(spark, sf_dir).filter("not endswith(condition, 'P2')")
    return inference.mann_whitney(rows, "condition", "words", "SB").drop("p")


def _marker_rates(spark, sf_dir):
    """A row for each conversation and marker, so that all markers are tested in one pass."""
    rates = F.array(*[F.struct(F.lit(k).alias("marker"), F.col(k).alias("rate")) for k in lx.MARKERS])
    return _by_conversation(spark, sf_dir).select("condition", F.explode(rates).alias("r")).select("condition", "r.*")


def mann_whitney_markers(spark, sf_dir):
    """Rates of each marker; the few-shot conditions would be circular."""
    rows = _marker_rates(spark, sf_dir).filter("not endswith(condition, 'P2')")
    return inference.mann_whitney(rows, "condition", "rate", "SB", ["marker"]).drop("p")


def _trend(spark, sf_dir):
    rows = _by_conversation(spark, sf_dir).filter("condition <> 'SB'")
    return rows.withColumn("step", F.substring("architecture", 2, 1).cast("int") - 1)


def spearman_trend(spark, sf_dir):
    return inference.spearman(_trend(spark, sf_dir), "step", "words", ["prompt_level"]).drop("p")


def kruskal(spark, sf_dir):
    return inference.kruskal(_trend(spark, sf_dir), "architecture", "words", ["prompt_level"]).drop("p")


def gradient(spark, sf_dir):
    means = _by_conversation(spark, sf_dir).groupBy("condition", "prompt_level").agg(F.avg("words").alias("words"))
    return inference.closest(means, "condition", "words", "SB", ["prompt_level"])


def ols_omnibus(spark, sf_dir):
    return inference.omnibus(_by_conversation(spark, sf_dir), "condition", "words", "SB").drop("p", "p_F")


def ols_markers(spark, sf_dir):
    return _rounded(inference.omnibus(_marker_rates(spark, sf_dir), "condition", "rate", "SB", ["marker"]).drop("p", "p_F"))


def few_shot(spark, sf_dir):
    """Excerpt from beyond the first 20 conversations by name."""
    turns = table_turns(spark, sf_dir).select(F.element_at(F.split("conv_id", "/"), -1).cast("long").alias("conversation_no"), "turn_index", "speaker", "text")
    files = turns.select("conversation_no", F.format_string("sw_%06d", "conversation_no").alias("file")).distinct()
    return gen.few_shot(turns, files, skip=20, n_turns=4)


def p_values(spark, sf_dir):
    rows = _by_conversation(spark, sf_dir)
    a = inference.welch(rows, "condition", "words", "SB").select("condition", F.lit("welch").alias("test"), "p")
    b = inference.mann_whitney(rows, "condition", "words", "SB").select("condition", F.lit("mann_whitney").alias("test"), "p")
    c = inference.omnibus(rows, "condition", "words", "SB").select("condition", F.lit("ols").alias("test"), "p")
    return a.union(b).union(c)


def mixed_model(spark, sf_dir):
    rows = metrics.tidy(table_turns(spark, sf_dir)).withColumns({"corpus_llm": (F.col("corpus") == "LLM").cast("int"), "later": (F.col("section") == "Later").cast("int")})
    return spark.createDataFrame(inference.mixed_model(rows, "words", "conv_id", ["corpus_llm", "later"]), "term string, coef double, se double, z double, p double, group_var double, residual_var double")


_MODEL = "term string, coef double, se double, z double, p double, group_var double, residual_var double"


def mixed_by_condition(spark, sf_dir):
    """words ~ corpus * section + (1 | conversation), each generated condition against the human one."""
    rows = metrics.tidy(table_turns(spark, sf_dir)).withColumn("later", (F.col("section") == "Later").cast("int"))
    return spark.createDataFrame(inference.mixed_models(rows, "words", "conv_id", "corpus_llm", ["later"], "condition", "SB"), f"condition string, {_MODEL}")


#: The condition that stands in for the human one.
ALIGN_BASE = "click"


def alignment_model(spark, sf_dir):
    """measure ~ condition * section + (1 | conversation), each condition against the human one; unlike above the
    condition is the reference. Conversations of conditions are apart."""
    rows = src.alignment_sections(_alignment(spark, sf_dir)).withColumns({"later": (F.col("section") == "Later").cast("int"), "conv": F.concat_ws("/", "condition", "conv_id")})
    found = [{"measure": dv, **r} for dv in ("cosine_semanticL", "syntax_stan", "lexical") for r in inference.mixed_models(rows, dv, "conv", "human", ["later"], "condition", ALIGN_BASE, first=1)]
    return spark.createDataFrame(found, f"measure string, condition string, {_MODEL}")


def vif(spark, sf_dir):
    rows = metrics.tidy(table_turns(spark, sf_dir))
    return spark.createDataFrame(inference.vif(rows, ["turn_index", "n_turns", "words"]), "term string, vif double")


# ---- around generation


def _metadata(spark, sf_dir):
    """Customers as caller metadata."""
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.cast("long").alias("conversation_no"), F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("'s do-it-yourself topic")).alias("topic_description"), F.lit(" Discuss it. ").alias("prompt"),
        F.concat(F.lit("9"), (key % 10).cast("string"), F.lit("0315")).alias("talk_day"),
        F.when(key % 2 == 0, "FEMALE").otherwise("MALE").alias("from_caller_sex"), F.when(key % 3 == 0, " f").otherwise("m").alias("to_caller_sex"),
        F.when(key % 7 == 0, "UNK").otherwise((1930 + key % 40).cast("string")).alias("from_caller_birth_year"), (1940 + key % 30).cast("string").alias("to_caller_birth_year"),
        (key % 11).cast("string").alias("from_caller_education"), F.lit("9").alias("to_caller_education"),
    )


def personas(spark, sf_dir):
    p = gen.personas(_metadata(spark, sf_dir))
    return p.select("conversation_no", "topic", "sb_prompt", *[F.col(f"persona_{x}")[f].alias(f"{x}_{f}") for x in "ab" for f in ("gender", "age", "education")])


def prompts(spark, sf_dir):
    rows = gen.personas(_metadata(spark, sf_dir)).withColumn("speaker", F.lit("ParticipantB"))
    history = F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit(t).alias("text")) for s, t in (("ParticipantA", "Hello!"), ("ParticipantB", "Hello!"))])
    rows = rows.withColumn("history", history)
    for kind, level in PROMPT_FORMS:
        made = gen.prompts(rows, level, kind, EXAMPLE if level == "P2" else "")
        rows = made.withColumn(f"{kind}_{level}", F.to_json("messages")).drop("messages")
    return rows.select("conversation_no", *[f"{kind}_{level}" for kind, level in PROMPT_FORMS])


PROMPT_FORMS = [(kind, level) for kind in ("C1", "C2", "AG") for level in ("P0", "P1", "P2")]
EXAMPLE = "ParticipantA: So, hi.\nParticipantB: Hi there."


def targets_todo(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("conversation_no")).distinct()
    files = c.withColumn("file", F.format_string("sw_%06d", F.col("conversation_no")))
    wanted = gen.targets(files, c.filter("conversation_no % 3 <> 0"), 40)
    return gen.todo(wanted, c.filter("conversation_no % 5 = 0"))


def tsv_rows(spark, sf_dir):
    return sinks.tsv_rows(table_turns(spark, sf_dir), min_turns=4)


def human_turn_files(spark, sf_dir):
    """First 30 conversations by name, before and after the filter on metadata."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("conversation_no"), F.format_string("sw_%06d", F.col("conv_id")).alias("file"))
    known = c.select("conversation_no").distinct().filter("conversation_no % 2 = 1")
    count = lambda df, name: df.agg(F.count("*").alias("turns"), F.countDistinct("file").alias("files")).withColumn("order", F.lit(name))
    limit_first = src.first_files(c, 30).join(known, "conversation_no", "left_semi")
    return count(src.first_files(c, 30, known), "filter, limit").union(count(limit_first, "limit, filter"))


def _alignment(spark, sf_dir):
    """Events as alignment measures; every seventh has none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda m, d: F.when(F.col("event_id") % d != 0, F.col("value") * m)
    families = {f"{f}_{k}": part(i + 1, d) for i, f in enumerate(("syntax_stan", "lexical")) for k, d in (("tok2", 2), ("lem2", 3), ("tok3", 5), ("lem3", 7))}
    return e.select(F.col("event_type").alias("condition"), F.col("user_id").cast("string").alias("conv_id"), (F.col("event_id") % 20).alias("turn_index"), part(1, 7).alias("cosine_semanticL"), *[c.alias(n) for n, c in families.items()])


def align_conv(spark, sf_dir):
    return src.alignment_by_conversation(_alignment(spark, sf_dir))


def align_sections(spark, sf_dir):
    rows = src.alignment_sections(_alignment(spark, sf_dir))
    return rows.groupBy("condition", "section").agg(F.count("*").alias("n"), F.avg("syntax_stan").alias("syntax_stan"), F.avg("lexical").alias("lexical"), F.avg("cosine_semanticL").alias("cosine"))


def stream_roles(spark, sf_dir):
    return stream.to_completion(stream.rates_by_role(stream.turn_stream(spark, stream.table_files(sf_dir, "conversations"), "*")), "parley_stream_roles")


# ---- oracles

WITH = "WITH " + TURNS_SQL


def _vectors_sql(docs: str) -> str:
    """Of docs(id, text): voc(term, df, tf, idf) and vec(id, term, w)."""
    return f""", tc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS term FROM {docs}) GROUP BY ALL)
, voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, ln((1 + (SELECT count(*) FROM {docs})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tc GROUP BY term ORDER BY df DESC, tf DESC, term DESC LIMIT 12000)
, raw AS (SELECT id, term, tc.tf / sum(tc.tf) OVER (PARTITION BY id) * idf AS w FROM tc JOIN voc USING (term))
, vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)
"""


_TURN_VECTORS = ", docs AS (SELECT {'c': conv_id, 't': turn_index} AS id, text FROM turns)" + _vectors_sql("docs")
_CONV = _TURN_VECTORS + """, cs AS (SELECT id.c AS id, term, sum(w) AS w FROM vec GROUP BY ALL), cv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM cs)
, mem0 AS (SELECT DISTINCT conv_id AS id, condition, topic FROM turns)
"""


def _ced_sql(groups: str, least: int) -> str:
    on = " AND ".join(f"a.{g} = b.{g}" for g in groups.split(", "))
    return _CONV + f"""
, mem AS (SELECT * FROM mem0 {"WHERE trim(topic) <> ''" if "topic" in groups else ""})
, size AS (SELECT {groups}, count(*) AS n FROM mem GROUP BY ALL HAVING count(*) >= {least}), ce AS (SELECT {groups}, term, sum(w) AS c FROM mem JOIN cv USING (id) GROUP BY ALL)
, ln AS (SELECT {groups}, sqrt(sum(c * c)) AS len FROM ce GROUP BY ALL), dt AS (SELECT id, {groups}, sum(w * c) AS dot FROM mem JOIN cv USING (id) JOIN ce USING ({groups}, term) GROUP BY ALL)
, dist AS (SELECT id, {groups}, 1 - coalesce(dot / len, 0) AS distance FROM mem LEFT JOIN dt USING (id, {groups}) LEFT JOIN ln USING ({groups}))
, ced AS (SELECT {groups}, avg(distance) AS "CED", min(distance) AS min_distance, max(distance) AS max_distance FROM dist GROUP BY ALL)
, pr AS (SELECT a.id, {", ".join("a." + g for g in groups.split(", "))}, coalesce((SELECT sum(x.w * y.w) FROM cv x JOIN cv y ON x.term = y.term WHERE x.id = a.id AND y.id = b.id), 0) AS dot FROM mem a JOIN mem b ON {on} AND a.id <> b.id)
, nn AS (SELECT id, {groups}, 1 - max(dot) AS nn_distance FROM pr GROUP BY ALL)
, res AS (SELECT {groups}, n, "CED", min_distance, max_distance, avg(nn_distance) AS mean_nn_distance, min(nn_distance) AS min_nn_distance FROM size JOIN ced USING ({groups}) LEFT JOIN nn USING ({groups}) GROUP BY ALL)
"""


_CAS = """, rows AS (SELECT conv_id, turn_index, lower(trim(topic)) AS topic, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn_index) AS prev FROM turns)
, r1 AS (SELECT * FROM rows WHERE prev IS NOT NULL), docs AS (SELECT {'c': conv_id, 't': turn_index, 'p': 'c'} AS id, prev AS text FROM r1 UNION ALL SELECT {'c': conv_id, 't': turn_index, 'p': 'r'} AS id, text FROM r1)
""" + _vectors_sql("docs") + """
, dots AS (SELECT r.id.c AS rc, r.id.t AS rt, c.id.c AS cc, c.id.t AS ct, sum(r.w * c.w) AS dot FROM vec r JOIN vec c ON r.term = c.term AND r.id.p = 'r' AND c.id.p = 'c' GROUP BY ALL)
, pool AS (SELECT a.conv_id, a.turn_index, b.conv_id AS bc, b.turn_index AS bt, b.prev AS ctx, a.topic <> '' AND count(*) FILTER (b.topic = a.topic AND b.conv_id <> a.conv_id) OVER (PARTITION BY a.conv_id, a.turn_index) >= 5 AS narrow, a.topic = b.topic AS same FROM r1 a, r1 b)
, wrong AS (SELECT conv_id, turn_index, avg(coalesce(dot, 0)) AS wrong, count(*) AS n FROM pool LEFT JOIN dots ON rc = conv_id AND rt = turn_index AND cc = bc AND ct = bt WHERE bc <> conv_id AND trim(ctx) <> '' AND (same OR NOT narrow) GROUP BY ALL)
, cas AS (SELECT r1.conv_id, r1.turn_index, coalesce(d.dot, 0) AS cas_real_similarity, wrong AS cas_wrong_similarity, coalesce(d.dot, 0) - wrong AS cas, coalesce(n, 0)::BIGINT AS cas_negatives
  FROM r1 LEFT JOIN wrong USING (conv_id, turn_index) LEFT JOIN dots d ON rc = r1.conv_id AND rt = r1.turn_index AND cc = r1.conv_id AND ct = r1.turn_index)
"""

_CONVS = ", m AS (SELECT conv_id, condition, architecture, prompt_level, avg(words) AS words FROM turns GROUP BY ALL)\n"
_MOM = _CONVS + ", s AS (SELECT condition, count(*) AS n, avg(words) AS mean, var_samp(words) AS var FROM m GROUP BY 1), b AS (SELECT n AS n0, mean AS mean0, var AS var0 FROM s WHERE condition = 'SB')\n"
_EDU = "CASE k % 11 " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in lx.EDUCATION.items()) + f" ELSE '{lx.EDUCATION['9']}' END"
_PERSONA_SQL = f"""p AS (SELECT k AS conversation_no, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment) || '''s do-it-yourself topic', '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS topic, 'Discuss it.' AS sb_prompt,
  CASE WHEN k % 2 = 0 THEN 'woman' ELSE 'man' END AS a_gender, CASE WHEN k % 7 = 0 THEN 40 ELSE 1990 + k % 10 - 1930 - k % 40 END::INT AS a_age, {_EDU} AS a_education,
  CASE WHEN k % 3 = 0 THEN 'woman' ELSE 'man' END AS b_gender, (1990 + k % 10 - 1940 - k % 30)::INT AS b_age, '{lx.EDUCATION['9']}' AS b_education FROM (SELECT c_custkey::BIGINT AS k, c_mktsegment FROM customer))"""

SQL = {
    "tfidf": WITH + _TURN_VECTORS + "SELECT id.c AS conv_id, id.t AS turn_index, term, w FROM vec",
    "tfidf_vocabulary": WITH + _TURN_VECTORS + "SELECT * FROM voc",
    "ced_by_condition": WITH + _ced_sql("condition", 1) + "SELECT res.*, CASE WHEN condition = 'SB' THEN 'SB' ELSE 'LLM' END AS source, split_part(condition, '-', 1) AS architecture, CASE WHEN condition = 'SB' THEN 'SB' ELSE split_part(condition, '-', 2) END AS prompt_level FROM res",
    "ced_by_topic": WITH + _ced_sql("topic, condition", 2) + "SELECT * FROM res",
    "ced_topic_matched": WITH + _ced_sql("topic, condition", 2) + """SELECT condition, count(*)::BIGINT AS n_topics, avg("CED") AS "CED", avg(mean_nn_distance) AS mean_nn_distance FROM res WHERE lower(trim(topic)) IN (SELECT lower(trim(topic)) FROM res WHERE condition = 'SB') GROUP BY condition""",
    "ced_nn": WITH + _ced_sql("condition", 1) + "SELECT mem.id, mem.condition, nn_distance FROM nn JOIN mem USING (id)",
    "ced_embeddings": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM e), c AS (SELECT label, i, sum(w) AS c FROM x GROUP BY ALL), l AS (SELECT label, sqrt(sum(c * c)) AS len FROM c GROUP BY 1), d AS (SELECT vec_id, label, 1 - sum(w * c) / any_value(len) AS d FROM x JOIN c USING (label, i) JOIN l USING (label) GROUP BY ALL) SELECT label, count(*)::BIGINT AS n, avg(d) AS \"CED\", min(d) AS min_distance, max(d) AS max_distance FROM d GROUP BY label",
    "nn_embeddings": "SELECT a.vec_id, a.label, 1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS nn_distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL",
    "centre_cosine": "WITH x AS (SELECT label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(w::DOUBLE) AS w FROM x GROUP BY ALL), c AS (SELECT label, list(w ORDER BY i) AS c FROM m GROUP BY label) SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], c) AS cosine FROM embeddings JOIN c USING (label)",
    "ced_concat": WITH + ", docs AS (SELECT conv_id AS id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_index) AS text FROM turns GROUP BY 1)" + _vectors_sql("docs") + ", mem AS (SELECT DISTINCT conv_id AS id, condition FROM turns), ce AS (SELECT condition, term, sum(w) AS c FROM mem JOIN vec USING (id) GROUP BY ALL), ln AS (SELECT condition, sqrt(sum(c * c)) AS len FROM ce GROUP BY 1), dt AS (SELECT id, sum(w * c) AS dot FROM mem JOIN vec USING (id) JOIN ce USING (condition, term) GROUP BY 1), dist AS (SELECT condition, 1 - coalesce(dot / len, 0) AS d FROM mem LEFT JOIN dt USING (id) LEFT JOIN ln USING (condition)) SELECT condition, count(*)::BIGINT AS n, avg(d) AS \"CED\", min(d) AS min_distance, max(d) AS max_distance FROM dist GROUP BY condition",
    "group_social": WITH + dialogue._TSI_SQL + _CAS + ", cc AS (SELECT conv_id, avg(cas) AS \"CAS\" FROM cas GROUP BY 1) SELECT condition, " + dialogue.IDENTITY + ", count(*)::BIGINT AS n_conversations, " + ", ".join(f'avg("{k}") AS "mean_{k}"' for k in labels.GROUPED) + " FROM tsi LEFT JOIN cc USING (conv_id) GROUP BY condition",
    "few_shot": WITH + ", f AS (SELECT no, printf('sw_%06d', no) AS file, count(*) AS n FROM base GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY file) AS i FROM f), o AS (SELECT no FROM r WHERE i > 20 AND n >= 6 ORDER BY file LIMIT 1) SELECT string_agg(CASE speaker WHEN 'A' THEN 'ParticipantA' WHEN 'B' THEN 'ParticipantB' ELSE speaker END || ': ' || text, chr(10) ORDER BY turn_index) AS excerpt FROM base JOIN o USING (no) WHERE turn_index < 4",
    "cas_exact": WITH + _CAS + "SELECT * FROM cas",
    "cas_conversations": WITH + _CAS + "SELECT conv_id, avg(cas) AS \"CAS\", count(cas)::BIGINT AS cas_turns FROM cas GROUP BY 1",
    "tidy_rows": WITH + "SELECT conv_id, turn_index, CASE WHEN condition = 'SB' THEN 'SB' ELSE 'LLM' END AS corpus, count(*) OVER (PARTITION BY conv_id) AS n_turns, CASE WHEN turn_index < count(*) OVER (PARTITION BY conv_id) / 2 THEN 'Earlier' ELSE 'Later' END AS section, words, " + ", ".join(f"len(regexp_extract_all(ascii, '(?i){p}'))::BIGINT AS {k}" for k, p in lx.MARKERS.items()) + " FROM turns",
    "welch": WITH + _MOM + "SELECT condition, n, n0, (mean - mean0) / sqrt(var / n + var0 / n0) AS t, (var / n + var0 / n0) ** 2 / ((var / n) ** 2 / (n - 1) + (var0 / n0) ** 2 / (n0 - 1)) AS df, (mean - mean0) / sqrt(((n - 1) * var + (n0 - 1) * var0) / (n + n0 - 2)) AS d FROM s, b WHERE condition <> 'SB' AND n > 1 AND n0 > 1",
    "mann_whitney": WITH + _CONVS + "SELECT a.condition, count(DISTINCT a.conv_id)::BIGINT AS n, count(DISTINCT b.conv_id)::BIGINT AS n0, sum(CASE WHEN a.words > b.words THEN 1.0::DOUBLE WHEN a.words = b.words THEN 0.5::DOUBLE ELSE 0 END) AS \"U\" FROM m a, m b WHERE a.condition NOT LIKE '%P2' AND a.condition <> 'SB' AND b.condition = 'SB' GROUP BY 1",
    "mann_whitney_markers": WITH + ", m0 AS (SELECT conv_id, condition, sum(words) AS w, " + ", ".join(f"sum(len(regexp_extract_all(ascii, '(?i){p}'))) AS {k}" for k, p in lx.MARKERS.items()) + " FROM turns GROUP BY ALL), m AS (" + " UNION ALL ".join(f"SELECT conv_id, condition, '{k}' AS marker, 100.0::DOUBLE * {k} / greatest(w, 1) AS v FROM m0" for k in lx.MARKERS) + ") SELECT a.condition, count(DISTINCT a.conv_id)::BIGINT AS n, count(DISTINCT b.conv_id)::BIGINT AS n0, sum(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0 END) AS \"U\", marker FROM m a JOIN m b USING (marker) WHERE a.condition NOT LIKE '%P2' AND a.condition <> 'SB' AND b.condition = 'SB' GROUP BY 1, marker",
    "spearman_trend": WITH + _CONVS + ", r AS (SELECT prompt_level, rank() OVER (PARTITION BY prompt_level ORDER BY architecture) + (count(*) OVER (PARTITION BY prompt_level, architecture) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY prompt_level ORDER BY words) + (count(*) OVER (PARTITION BY prompt_level, words) - 1) / 2.0::DOUBLE AS ry FROM m WHERE condition <> 'SB') SELECT prompt_level, count(*)::BIGINT AS n, corr(rx, ry) AS rho FROM r GROUP BY 1",
    "kruskal": WITH + _CONVS + ", r AS (SELECT *, count(*) OVER (PARTITION BY prompt_level, words) AS t, rank() OVER (PARTITION BY prompt_level ORDER BY words) + (count(*) OVER (PARTITION BY prompt_level, words) - 1) / 2.0::DOUBLE AS k FROM m WHERE condition <> 'SB'), g AS (SELECT prompt_level, architecture, count(*) AS n, sum(k) AS r, sum(t * t - 1) AS ties FROM r GROUP BY ALL), s AS (SELECT prompt_level, sum(n) AS n, sum(r * r / n) AS q, sum(ties) AS ties, count(*) AS groups FROM g GROUP BY 1) SELECT prompt_level, (12.0::DOUBLE / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ** 3 - n)) AS \"H\", groups FROM s WHERE groups > 1",
    "gradient": WITH + _CONVS + ", c AS (SELECT condition, prompt_level, avg(words) AS w FROM m GROUP BY ALL), d AS (SELECT prompt_level, condition, abs(w - (SELECT w FROM c WHERE condition = 'SB')) AS distance FROM c WHERE condition <> 'SB') SELECT *, first_value(condition) OVER (PARTITION BY prompt_level ORDER BY distance, condition) AS closest FROM d",
    "ols_omnibus": WITH + _MOM + ", o AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum((n - 1) * coalesce(var, 0)) AS w FROM s), bt AS (SELECT sum(n * (mean - grand) ** 2) AS bt FROM s, o), q AS (SELECT s.*, b.*, o.*, bt, w / (nn - k) AS mse, condition = 'SB' AS sb FROM s, b, o, bt) SELECT condition, bt / (k - 1) / mse AS \"F\", (k - 1)::BIGINT AS df1, (nn - k)::BIGINT AS df2, CASE WHEN sb THEN mean ELSE mean - mean0 END AS coef, CASE WHEN sb THEN mean / sqrt(mse / n) ELSE (mean - mean0) / sqrt(mse * (1.0::DOUBLE / n + 1.0::DOUBLE / n0)) END AS t FROM q",
    "ols_markers": WITH + ", m0 AS (SELECT conv_id, condition, sum(words) AS w, " + ", ".join(f"sum(len(regexp_extract_all(ascii, '(?i){p}'))) AS {k}" for k, p in lx.MARKERS.items()) + " FROM turns GROUP BY ALL), m AS (" + " UNION ALL ".join(f"SELECT condition, '{k}' AS marker, 100.0::DOUBLE * {k} / greatest(w, 1) AS v FROM m0" for k in lx.MARKERS) + "), s AS (SELECT marker, condition, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS var FROM m GROUP BY ALL), b AS (SELECT marker, n AS n0, mean AS mean0 FROM s WHERE condition = 'SB'), o AS (SELECT marker, sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum((n - 1) * var) AS w FROM s GROUP BY 1), bt AS (SELECT marker, sum(n * (mean - grand) ** 2) AS bt FROM s JOIN o USING (marker) GROUP BY 1), q AS (SELECT *, w / (nn - k) AS mse, condition = 'SB' AS sb FROM s JOIN b USING (marker) JOIN o USING (marker) JOIN bt USING (marker)) SELECT condition, bt / (k - 1) / mse AS \"F\", (k - 1)::BIGINT AS df1, (nn - k)::BIGINT AS df2, CASE WHEN sb THEN mean ELSE mean - mean0 END AS coef, CASE WHEN sb THEN mean / sqrt(mse / n) ELSE (mean - mean0) / sqrt(mse * (1.0::DOUBLE / n + 1.0::DOUBLE / n0)) END AS t, marker FROM q",
    "vif": WITH + ", x AS (SELECT turn_index AS a, count(*) OVER (PARTITION BY conv_id) AS b, words AS c FROM turns), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r) SELECT unnest(['turn_index', 'n_turns', 'words']) AS term, unnest([(1 - bc * bc) / det, (1 - ac * ac) / det, (1 - ab * ab) / det]) AS vif FROM d",
    "personas": "WITH " + _PERSONA_SQL + " SELECT * FROM p",
    "targets_todo": "WITH c AS (SELECT DISTINCT conv_id AS conversation_no, printf('sw_%06d', conv_id) AS file FROM conversations), t AS (SELECT * FROM c WHERE conversation_no % 3 <> 0 ORDER BY file LIMIT 40) SELECT * FROM t WHERE conversation_no % 5 <> 0",
    "tsv_rows": WITH + ", r AS (SELECT conv_id, turn_index, speaker AS participant, trim(replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' '), '\"', '')) AS content FROM turns) SELECT * FROM r WHERE content <> '' AND conv_id IN (SELECT conv_id FROM r WHERE content <> '' GROUP BY 1 HAVING count(*) >= 4)",
    "human_turn_files": "WITH c AS (SELECT conv_id, printf('sw_%06d', conv_id) AS file FROM conversations), a AS (SELECT DISTINCT file FROM c WHERE conv_id % 2 = 1 ORDER BY file LIMIT 30), b AS (SELECT DISTINCT file FROM c ORDER BY file LIMIT 30) SELECT count(*)::BIGINT AS turns, count(DISTINCT file)::BIGINT AS files, 'filter, limit' AS \"order\" FROM c WHERE file IN (FROM a) UNION ALL SELECT count(*), count(DISTINCT file), 'limit, filter' FROM c WHERE file IN (FROM b) AND conv_id % 2 = 1",
    "align_conv": "SELECT event_type AS condition, user_id::VARCHAR AS conv_id, avg(value) FILTER (event_id % 7 <> 0) AS mean_cosine, count(value) FILTER (event_id % 7 <> 0)::BIGINT AS n FROM events GROUP BY 1, 2",
    "align_sections": "WITH e AS (SELECT event_type AS condition, event_id % 20 AS i, value AS v, list_filter([2, 3, 5, 7], lambda d: event_id % d <> 0) AS ks, event_id % 7 <> 0 AS has FROM events) SELECT condition, CASE WHEN i < 5 THEN 'Earlier' ELSE 'Later' END AS section, count(*)::BIGINT AS n, avg(CASE WHEN len(ks) > 0 THEN v END) AS syntax_stan, avg(CASE WHEN len(ks) > 0 THEN 2 * v END) AS lexical, avg(CASE WHEN has THEN v END) AS cosine FROM e WHERE i < 10 GROUP BY 1, 2",
    "stream_roles": "SELECT role, count(*)::BIGINT AS turns, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY role",
}



_GIVEN = """, gk AS (SELECT text, min(split_part(conv_id, '/', 2)::BIGINT * 64 + turn_index) % (SELECT count(*) FROM embeddings) AS k FROM turns GROUP BY text)
, gv AS (SELECT text, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM gk JOIN embeddings ON vec_id = k)
, vec AS (SELECT id, generate_subscripts(v, 1) AS term, unnest(v) AS w FROM docs JOIN gv USING (text))
"""
SQL["ced_given"] = (WITH + _ced_sql("condition", 1) + "SELECT * FROM res").replace(_vectors_sql("docs"), _GIVEN)
SQL["cas_given"] = (WITH + _CAS + "SELECT * FROM cas").replace(_vectors_sql("docs"), _GIVEN)
SQL["words_chart"] = WITH + _MOM + "SELECT condition, n, mean AS mean_words, sqrt(var / n) AS standard_error, mean0 AS baseline_words FROM s, b WHERE condition <> 'SB'"


def _prompt_sql(kind: str, level: str) -> str:
    """The messages of one form as JSON, the templates filled in by replacing."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    form = "P0" if level == "P0" else "P1"
    who = {x: f"'a ' || {x}_age || '-year-old ' || {x}_gender || ' with ' || {x}_education" for x in "ab"}
    shot = gen.EXAMPLE.replace("{example}", EXAMPLE) if level == "P2" else ""
    values = {
        "{task}": text(gen.TOPIC[form]), "{goal}": "sb_prompt", "{topic}": "topic", "{a}": who["a"], "{b}": who["b"], "{me}": who["b"], "{length}": text(gen.LENGTH), "{style}": text(gen.STYLE),
        "{peer}": text(gen.PEER), "{seed}": text(gen.SEED_TURNS), "{shot}": text(shot), "{speaker}": "'ParticipantB'", "{log}": text(gen.SEED_TURNS),
    }
    filled = text(gen.PROMPTS[kind, form])
    for name, value in values.items():
        filled = f"replace({filled}, '{name}', {value})"
    message = lambda role, content: f"{{'role': '{role}', 'content': {content}}}"
    messages = [message("user", filled)] if kind != "AG" else [message("system", filled), message("user", "'Hello!'"), message("assistant", "'Hello!'"), message("user", text(gen.QUIET))]
    return f"to_json([{', '.join(messages)}])::VARCHAR AS \"{kind}_{level}\""


SQL["prompts"] = "WITH " + _PERSONA_SQL + " SELECT conversation_no, " + ", ".join(_prompt_sql(*form) for form in PROMPT_FORMS) + " FROM p"

for _name, _columns in {
    "ced_by_condition": '"CED", min_distance, max_distance, mean_nn_distance, min_nn_distance', "ced_by_topic": '"CED", min_distance, max_distance, mean_nn_distance, min_nn_distance',
    "ced_given": '"CED", min_distance, max_distance, mean_nn_distance, min_nn_distance', "cas_given": "cas_real_similarity, cas_wrong_similarity, cas", "words_chart": "mean_words, standard_error, baseline_words",
    "ced_concat": '"CED", min_distance, max_distance', "group_social": ", ".join(f'"mean_{k}"' for k in labels.GROUPED), "ols_markers": '"F", coef, t',
    "ced_topic_matched": '"CED", mean_nn_distance', "ced_nn": "nn_distance", "ced_embeddings": '"CED", min_distance, max_distance', "nn_embeddings": "nn_distance", "centre_cosine": "cosine", "cas_exact": "cas_real_similarity, cas_wrong_similarity, cas", "cas_conversations": '"CAS"',
}.items():
    _list = ", ".join(f"round({c}, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in _columns.split(", "))
    SQL[_name] = f"SELECT * REPLACE ({_list}) FROM ({SQL[_name]})"

QUERIES = {
    f.__name__: f
    for f in (
        tfidf, tfidf_vocabulary, ced_given, cas_given, words_chart, ced_by_condition, ced_by_topic, ced_topic_matched, ced_nn, ced_concat, group_social, ced_embeddings, nn_embeddings, centre_cosine, cas_exact, cas_sampled, cas_conversations, pca, tidy_rows, welch, mann_whitney, mann_whitney_markers,
        spearman_trend, kruskal, gradient, ols_omnibus, ols_markers, few_shot, p_values, mixed_model, mixed_by_condition, alignment_model, vif, personas, prompts, targets_todo, tsv_rows, human_turn_files, align_conv, align_sections, stream_roles,
    )
}
