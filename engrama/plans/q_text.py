"""Queries of the text rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions import extraction as X
from engrama.functions import scoring as S
from engrama.functions import security as K
from engrama.functions import text as T
from engrama.operators import retrieval as R
from engrama.operators.recall import STOP
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}'']+'), lambda x: x <> '')"
ALNUM = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


@query("token_counts", f"SELECT doc_id, len({TOK}) AS tokens, len(list_distinct({TOK})) AS kinds FROM documents")
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.tokens(c("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query("vocabulary", f"SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY token")
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.explode(T.tokens(c("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return d.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query("heuristic_entities", "SELECT rid, count(*) AS entities, string_agg(entity, ',' ORDER BY entity) AS names FROM links GROUP BY rid", ("links",))
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select(c("doc_id").alias("rid"), T.proper_nouns(c("text")).alias("e")).where(F.size("e") > 0)
    return d.select("rid", F.size("e").cast("long").alias("entities"), F.array_join(F.array_sort("e"), ",").alias("names"))


@query(
    "entity_in_text",
    r"""SELECT doc_id, rel.entity FROM documents, (SELECT unnest(['of the', 'in a', 'and the', 'de la']) AS entity) rel
    WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}'']+'), lambda x: x <> ''), ' ') || ' ', ' ' || rel.entity || ' ')""",
)
def _(spark, sf_dir):
    # a handful of literal entities per document: an array, not a join
    hits = F.filter(F.array(*map(F.lit, ("of the", "in a", "and the", "de la"))), lambda e: F.contains(c("p"), F.concat(F.lit(" "), e, F.lit(" "))))
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit(" "), F.array_join(T.tokens(c("text")), " "), F.lit(" ")).alias("p"))
    return d.select("doc_id", F.explode(hits).alias("entity"))


@query(
    "text_features",
    f"""SELECT doc_id, length(text) AS chars, len(t) AS words, len(regexp_extract_all(text, '[.!?]')) AS sentences,
    {", ".join(f"len(list_filter(t, lambda x: x IN ({_quoted(w)}))) AS {n}" for n, w in (("negations", T.NEGATIONS), ("temporal", T.TEMPORAL), ("modal", T.MODALS)))} FROM (SELECT doc_id, text, {TOK} AS t FROM documents)""",
)
def _(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.features(c("text")).alias("f"))
    return d.select("doc_id", *[c(f"f.{k}").cast("long").alias(k) for k in ("chars", "words", "sentences", "negations", "temporal", "modal")])


def _stem_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN length({x}) > {len(s) + 2} AND ends_with({x}, '{s}') THEN substr({x}, 1, length({x}) - {len(s)})" for s in S.SUFFIXES) + f" ELSE {x} END"


def _hit_sql(words: list[str]) -> str:
    names = ", ".join(f"'{w}'" for w in words)
    return f"(tok IN ({names}) OR stm IN ({names})" + "".join(f" OR (length(tok) >= 4 AND starts_with(tok, '{w}')) OR (length(stm) >= 4 AND starts_with('{w}', stm))" for w in words) + ")"


@query(
    "text_sentiment",
    f"""WITH w AS (SELECT conv_id, turn, unnest({ALNUM}) AS tok FROM conversations), s AS (SELECT *, {_stem_sql("tok")} AS stm FROM w),
    n AS (SELECT conv_id, turn, sum(CASE WHEN {_hit_sql(S.NEGATIVE)} THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN {_hit_sql(S.POSITIVE)} THEN 1 ELSE 0 END) AS good FROM s GROUP BY 1, 2)
    SELECT conv_id, turn, CASE WHEN coalesce(bad, 0) > coalesce(good, 0) THEN -1.0::DOUBLE WHEN coalesce(good, 0) > coalesce(bad, 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sentiment FROM conversations LEFT JOIN n USING (conv_id, turn)""",
)
def _(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.text_sentiment(c("text")).alias("sentiment"))


@query("stem_vocabulary", f"WITH w AS (SELECT DISTINCT unnest({ALNUM}) AS tok FROM conversations) SELECT tok AS word, {_stem_sql('tok')} AS stem FROM w")
def _(spark, sf_dir):
    w = A.table(spark, sf_dir, "conversations").select(F.explode(T.alnum_tokens(c("text"))).alias("word")).distinct()
    return w.select("word", S.sentiment_stem(c("word")).alias("stem"))


#: Names that the tables don't hold, beside theirs.
NAMES = ["Priya Sharma", "Project Athena", "Spark Streaming", "FAISS", "K8S", "R2D2", "Redis", "postgres", "Mia Lin Chen", "Bo", "jo Ann", "ÅSA", "X", "Éva Nagy", " Team Blue ", "API", "New York"]
_NAMES = "(SELECT s_name AS name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]))"


def _listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _type_sql(name):
    """The rule as SQL, from its text: listed or all capitals; else two capitalised words, unless one is a thing or a technology."""
    w, two = f"string_split_regex(trim({name}), '\\s+')", f"len(string_split_regex(trim({name}), '\\s+')) = 2"
    upper = lambda x: f"(upper(left({x}, 1)) = left({x}, 1) AND lower(left({x}, 1)) <> left({x}, 1))"
    named = f"{two} AND {upper(w + '[1]')} AND {upper(w + '[2]')}"
    return f"""CASE WHEN lower(trim({name})) IN {_listed(T.TECH)} OR (length(trim({name})) > 1 AND upper(trim({name})) = trim({name})) THEN 'tech' WHEN {named} AND lower({w}[1]) IN {_listed(T.NOT_PERSONS)} THEN 'unknown'
    WHEN {named} AND (lower({w}[1]) IN {_listed(T.TECH)} OR lower({w}[2]) IN {_listed(T.TECH)}) THEN 'tech' WHEN {named} THEN 'person' ELSE 'unknown' END"""


def names(spark, sf_dir):
    t = lambda n, k: A.table(spark, sf_dir, n).select(c(k).alias("name"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, NAMES))).alias("name"))
    return t("supplier", "s_name").union(t("part", "p_name")).union(t("part", "p_brand")).union(t("nation", "n_name")).union(listed)


@query("entity_types", f"SELECT name, {_type_sql('name')} AS kind FROM {_NAMES}")
def _(spark, sf_dir):
    return names(spark, sf_dir).select("name", T.entity_type(c("name")).alias("kind"))


@query("conflict_types", f"SELECT dst, CASE WHEN r IN {_listed(T.IDENTITY)} THEN 'identity_fact' WHEN r IN {_listed(T.PREFERENCE)} THEN 'preference' ELSE 'minor' END AS kind FROM (SELECT DISTINCT dst, ['spouse', 'likes', 'due_on', 'lives_in'][1 + CAST(substr(dst, 2) AS BIGINT) % 4] AS r FROM edges)", ("edges",))
def _(spark, sf_dir):
    rel = F.element_at(F.array(*map(F.lit, ("spouse", "likes", "due_on", "lives_in"))), (F.substring("dst", 2, 20).cast("long") % 4 + 1).cast("int"))
    return A.edges(spark, sf_dir).select("dst").distinct().select("dst", T.conflict_type(rel).alias("kind"))


@query("date_like_tokens", r"SELECT p_name AS token, regexp_matches(p_name, '^\d{4}(-\d{1,2}){0,2}$') AS is_date FROM part UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), true FROM orders")
def _(spark, sf_dir):
    names = A.table(spark, sf_dir, "part").select(c("p_name").alias("token")).union(A.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return names.select("token", T.is_date_like(c("token")).alias("is_date"))


@query(
    "token_jaccard",
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOK}) AS t FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE ELSE 0 END, 6) AS jaccard
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def _(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(c("text"))).alias("t"))
    after = t.withColumn("next", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn")))
    return after.where("next is not null").select("conv_id", "turn", F.round(T.jaccard(c("t"), c("next")), 6).alias("jaccard"))


@query("normalize_lineage", "SELECT src, dst, extractor, polarity, array_to_string(lineage, ',') AS lineage, len(lineage) AS n FROM claims", ("claims",))
def _(spark, sf_dir):
    return A.claims(spark, sf_dir).select("src", "dst", "extractor", "polarity", F.array_join("lineage", ",").alias("lineage"), F.size("lineage").cast("long").alias("n"))


@query("content_hashes", "SELECT src, sha256(string_agg(DISTINCT dst, '|' ORDER BY dst)) AS hash FROM claims GROUP BY src", ("claims",))
def _(spark, sf_dir):
    return A.claims(spark, sf_dir).groupBy("src").agg(T.content_hash(F.collect_set("dst")).alias("hash"))


@query("cooldown_keys", "SELECT session_id, 'redundancy:' || string_agg(rid::VARCHAR, ',' ORDER BY rid::VARCHAR) AS key FROM memories GROUP BY session_id", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).groupBy("session_id").agg(T.cooldown_key(F.lit("redundancy"), F.collect_list(c("rid").cast("string"))).alias("key"))


@query(
    "bm25_topk",
    f"""WITH p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS al FROM l),
    q AS (SELECT * FROM (SELECT DISTINCT item_id, unnest({TOK}) AS token FROM benchmark) WHERE token NOT IN {_listed(STOP)}), d AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM q JOIN p USING (token) JOIN d USING (token) JOIN l USING (doc_id), g GROUP BY 1, 2)
    SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM s) WHERE k <= 10""",
)
def _(spark, sf_dir):
    index = R.Postings(docs(spark, sf_dir), "doc_id")
    terms = A.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(c("text")))).alias("token")).where(~c("token").isin(*STOP))
    s = index.bm25(terms, "item_id")
    top = R.top_per(s, "item_id", F.round("score", 9), "doc_id", 10)
    return top.select("item_id", "doc_id", F.round("score", 5).alias("score"))


@query("heuristic_relations")
def _(spark, sf_dir):
    # nations and regions as sentences, to have names and phrases
    n, r = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    t = n.join(r, c("n_regionkey") == c("r_regionkey")).select("n_nationkey", F.concat(F.lit("Bureau "), F.initcap(F.translate("n_name", "_0123456789", " abcdefghij")), F.when(c("n_nationkey") % 3 == 0, " is not").otherwise(" is"), F.lit(" based in "), F.initcap("r_name")).alias("text"))
    return t.select("n_nationkey", F.explode(X.relations(c("text"))).alias("x")).select("n_nationkey", "x.*")


RELATIONS = ["lives_in", "uses", "knows", "hums", "Founded", "hosted_on", "works_on", "extends", "spoke_at", "studies"]
_ENDS = [(X.PERSON_PERSON, "'person'", "person"), (X.PERSON_PLACE, "'person'", "place"), (X.PERSON_ORGANIZATION, "'person'", "organization"), (X.ANY_TECH, "made", "tech"), (X.ANY_INFRASTRUCTURE, "made", "infrastructure"), (X.PERSON_PROJECT, "'person'", "project"), (X.PROJECT_PROJECT, "'project'", "project"), (X.ANY_EVENT, "a", "event"), (X.PERSON_CONCEPT, "'person'", "concept")]


@query(
    "relation_end_types",
    f"""WITH n AS (SELECT DISTINCT name FROM {_NAMES}), t AS (SELECT name, rel, {_type_sql("name")} AS a FROM n, (SELECT unnest({RELATIONS}) AS rel)), m AS (SELECT *, CASE WHEN a = 'unknown' THEN 'project' ELSE a END AS made FROM t)
    SELECT name, rel, CASE {" ".join(f"WHEN lower(rel) IN {_listed(r)} THEN {a}" for r, a, _ in _ENDS)} ELSE a END AS src_kind, CASE {" ".join(f"WHEN lower(rel) IN {_listed(r)} THEN '{b}'" for r, _, b in _ENDS)} ELSE 'tech' END AS dst_kind FROM m""",
)
def _(spark, sf_dir):
    rows = names(spark, sf_dir).distinct().withColumn("rel", F.explode(F.array(*map(F.lit, RELATIONS))))
    return rows.withColumn("e", X.end_types(c("rel"), c("name"), F.lit("Redis"))).select("name", "rel", c("e.src").alias("src_kind"), c("e.dst").alias("dst_kind"))


@query("encrypt_round_trip", "SELECT item_id, text AS plain, true AS hidden FROM benchmark")
def _(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    b = A.table(spark, sf_dir, "benchmark").withColumn("secret", K.encrypt(c("text"), key))
    return b.select("item_id", K.decrypt(c("secret"), key).alias("plain"), (c("secret") != c("text")).alias("hidden"))


@query("clock_order", "SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id % 4, user_id % 3, event_id) AS place FROM events QUALIFY place <= 100")
def _(spark, sf_dir):
    o = A.oplog(spark, sf_dir).withColumn("h", K.clock_column(c("ms"), c("counter"), c("node")))
    top = o.orderBy("h", "op_id").limit(100)  # the first hundred, a report
    return top.select(c("op_id").alias("event_id"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", "op_id")).cast("long").alias("place"))
