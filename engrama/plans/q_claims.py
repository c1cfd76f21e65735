"""Queries of claims, propositions, evidence mass and contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.functions import timing as T
from engrama.operators import claims as C
from engrama.operators import moves as V
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
PROP = "src, rel, dst, namespace"
KEY = ["src", "rel", "dst", "namespace"]


def claims(spark, sf_dir):
    return A.claims(spark, sf_dir)


@query("get_claims", "SELECT src, dst, polarity, extractor, valid_from FROM claims WHERE src = 's1' OR dst = 'p5' ORDER BY valid_from DESC, src, dst, extractor, polarity", ("claims",))
def _(spark, sf_dir):
    return claims(spark, sf_dir).where("src = 's1' or dst = 'p5'").orderBy(F.desc("valid_from"), "src", "dst", "extractor", "polarity").select("src", "dst", "polarity", "extractor", "valid_from")


@query("claim_status", "SELECT src, dst, extractor, polarity, CASE WHEN polarity < 0 THEN 'negative' WHEN valid_to IS NOT NULL AND valid_to < 1000000000.0 THEN 'historical' WHEN valid_to IS NOT NULL THEN 'superseded' ELSE 'current' END AS status FROM claims", ("claims",))
def _(spark, sf_dir):
    s = F.when(c("polarity") < 0, "negative").when(c("valid_to") < 1e9, "historical").when(c("valid_to").isNotNull(), "superseded").otherwise("current")
    return claims(spark, sf_dir).select("src", "dst", "extractor", "polarity", s.alias("status"))


@query("polarity_conflicts", f"SELECT DISTINCT {PROP} FROM claims a WHERE polarity = 1 AND EXISTS (SELECT 1 FROM claims b WHERE b.src = a.src AND b.rel = a.rel AND b.dst = a.dst AND b.namespace = a.namespace AND b.polarity = -1)", ("claims",))
def _(spark, sf_dir):
    # one aggregation instead of a self-join
    return claims(spark, sf_dir).groupBy(*KEY).agg(F.min("polarity").alias("a"), F.max("polarity").alias("b")).where("a = -1 and b = 1").select(*KEY)


@query(
    "claim_object_conflicts",
    """WITH k AS (SELECT DISTINCT src, rel, namespace, dst FROM claims WHERE polarity = 1) SELECT src, rel, namespace, count(*) AS objects, count(*) * (count(*) - 1) // 2 AS pairs, min(dst) AS first_dst, max(dst) AS last_dst FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    ("claims",),
)
def _(spark, sf_dir):
    # the number of conflicting pairs follows from the number of objects: no pair is made
    k = claims(spark, sf_dir).where("polarity = 1").select("src", "rel", "namespace", "dst").distinct()
    g = k.groupBy("src", "rel", "namespace").agg(F.count("*").alias("objects"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst")).where("objects > 1")
    return g.select("src", "rel", "namespace", "objects", F.expr("objects * (objects - 1) div 2").alias("pairs"), "first_dst", "last_dst")


#: Written from the rules' text with pairs of claims, where the operators count without making any.
OMEGA = f"""named AS (SELECT claim_id, {PROP}, polarity, unnest(lineage) AS x FROM claims),
    every AS (SELECT {PROP}, polarity, count(DISTINCT x) AS u FROM named GROUP BY {PROP}, polarity),
    hit AS (SELECT claim_id, count(*) AS i FROM named a WHERE EXISTS (SELECT 1 FROM named b WHERE b.src = a.src AND b.rel = a.rel AND b.dst = a.dst AND b.namespace = a.namespace AND b.polarity = a.polarity AND b.x = a.x AND b.claim_id <> a.claim_id) GROUP BY claim_id),
    other AS (SELECT a.claim_id, count(b.claim_id) AS n, coalesce(sum((b.extractor = a.extractor)::INT), 0) AS same, coalesce(max(b.self_generated::INT), 0) AS gen FROM claims a LEFT JOIN claims b
        ON b.src = a.src AND b.rel = a.rel AND b.dst = a.dst AND b.namespace = a.namespace AND b.polarity = a.polarity AND b.claim_id <> a.claim_id GROUP BY a.claim_id),
    o AS (SELECT c.*, coalesce(i, 0) / u::DOUBLE AS jaccard, 1 / (1 + 0.5 * coalesce(i, 0) / u::DOUBLE + 0.3 * CASE WHEN n > 0 THEN same / n::DOUBLE ELSE 0 END + 0.7 * CASE WHEN self_generated AND gen = 1 THEN 1 ELSE 0 END) AS omega
        FROM claims c JOIN every USING ({PROP}, polarity) JOIN other USING (claim_id) LEFT JOIN hit USING (claim_id))"""
MASS = f"""m AS (SELECT {PROP}, coalesce(sum(weight * omega) FILTER (polarity = 1), 0) AS support, coalesce(sum(weight * omega) FILTER (polarity = -1), 0) AS attack, coalesce(sum(omega) FILTER (polarity = 1), 0) AS si, coalesce(sum(omega) FILTER (polarity = -1), 0) AS ai, count(*) AS claims FROM o GROUP BY {PROP})"""
OPPOSITES = f"""p AS (SELECT a.src, a.rel, a.dst, a.namespace, a.lineage = b.lineage AND len(a.lineage) > 0 AS source, a.source_rid = b.source_rid AND a.extractor <> b.extractor AS artifact,
    coalesce(a.valid_to, 'infinity'::DOUBLE) < coalesce(b.valid_from, '-infinity'::DOUBLE) OR coalesce(b.valid_to, 'infinity'::DOUBLE) < coalesce(a.valid_from, '-infinity'::DOUBLE) AS apart
    FROM claims a JOIN claims b USING ({PROP}) WHERE a.polarity = 1 AND b.polarity = -1),
    q AS (SELECT {PROP}, count(*) FILTER (source) AS same_source, count(*) FILTER (artifact) AS same_artifact, count(*) FILTER (NOT apart) AS overlapping, count(*) FILTER (apart) AS separable FROM p GROUP BY {PROP})"""
CONTEST = f"""WITH {OMEGA}, {MASS}, {OPPOSITES}, h AS (SELECT src, rel, dst, count(DISTINCT namespace) AS spaces FROM claims GROUP BY 1, 2, 3),
    f AS (SELECT m.*, coalesce(same_source, 0) AS same_source, coalesce(same_artifact, 0) AS same_artifact, coalesce(overlapping, 0) AS overlapping, coalesce(separable, 0) AS separable,
    (CASE WHEN support > 2 AND si < 2 THEN 1 ELSE 0 END + CASE WHEN same_source > 0 THEN 2 ELSE 0 END + CASE WHEN spaces > 1 THEN 4 ELSE 0 END + CASE WHEN same_artifact > 0 THEN 8 ELSE 0 END + CASE WHEN overlapping > 0 THEN 16 ELSE 0 END)::BIGINT AS flags
    FROM m JOIN h USING (src, rel, dst) LEFT JOIN q USING ({PROP}))"""


@query("claim_omegas", f"WITH {OMEGA} SELECT claim_id, round(omega, 6) AS omega FROM o", ("claims",))
def _(spark, sf_dir):
    return C.omegas(claims(spark, sf_dir)).select("claim_id", F.round("omega", 6).alias("omega"))


@query("lineage_mass", f"WITH {OMEGA}, {MASS} SELECT {PROP}, round(support, 6) AS support, round(attack, 6) AS attack, round(si, 6) AS support_independence, round(ai, 6) AS attack_independence, claims FROM m", ("claims",))
def _(spark, sf_dir):
    return C.mass(claims(spark, sf_dir)).select(*KEY, *[F.round(x, 6).alias(x) for x in ("support", "attack", "support_independence", "attack_independence")], "claims")


@query("modality_consilience", f"SELECT {PROP}, round(least(1, count(DISTINCT modality) FILTER (polarity = 1) / 6.0::DOUBLE), 6) AS consilience, round(coalesce(avg(self_generated::INT) FILTER (polarity = 1), 0), 6) AS self_generated FROM claims GROUP BY {PROP}", ("claims",))
def _(spark, sf_dir):
    return C.write_tier(claims(spark, sf_dir)).select(*KEY, F.round("consilience", 6).alias("consilience"), F.round("self_generated", 6).alias("self_generated"))


@query(
    "temporal_coherence",
    f"""WITH l AS (SELECT {PROP}, polarity, lag(polarity) OVER (PARTITION BY {PROP} ORDER BY created_at, claim_id) AS before FROM claims)
    SELECT {PROP}, round(CASE WHEN count(*) > 1 THEN 1 - sum(CASE WHEN before <> polarity THEN 1 ELSE 0 END) / (count(*) - 1)::DOUBLE ELSE 1 END, 6) AS coherence FROM l GROUP BY {PROP}""",
    ("claims",),
)
def _(spark, sf_dir):
    return C.temporal_coherence(claims(spark, sf_dir)).select(*KEY, F.round("coherence", 6).alias("coherence"))


@query("leave_one_out_jaccard", f"WITH {OMEGA} SELECT claim_id, round(jaccard, 6) AS jaccard FROM o", ("claims",))
def _(spark, sf_dir):
    return C.leave_one_out(claims(spark, sf_dir)).select("claim_id", F.round("jaccard", 6).alias("jaccard"))


@query("contest_flags", f"{CONTEST} SELECT {PROP}, round(support, 6) AS support, round(attack, 6) AS attack, same_source, same_artifact, overlapping, separable, flags FROM f", ("claims",))
def _(spark, sf_dir):
    return C.contest_state(claims(spark, sf_dir)).select(*KEY, F.round("support", 6).alias("support"), F.round("attack", 6).alias("attack"), "same_source", "same_artifact", "overlapping", "separable", "flags")


@query("flagged_propositions", f"{CONTEST} SELECT {PROP}, flags FROM f WHERE flags & 11 <> 0", ("claims",))
def _(spark, sf_dir):
    return C.flagged(claims(spark, sf_dir), C.DUPLICATION_RISK | C.SAME_SOURCE | C.SAME_ARTIFACT).select(*KEY, "flags")


@query("same_lineage_opposites", f"WITH {OPPOSITES} SELECT {PROP}, same_source FROM q WHERE same_source > 0", ("claims",))
def _(spark, sf_dir):
    return C.same_source_opposites(claims(spark, sf_dir)).where("same_source > 0")


@query("same_artifact_extractors", f"WITH {OPPOSITES} SELECT {PROP}, same_artifact FROM q WHERE same_artifact > 0", ("claims",))
def _(spark, sf_dir):
    return C.same_artifact_extractors(claims(spark, sf_dir)).where("same_artifact > 0")


@query("temporal_conflict_counts", f"WITH {OPPOSITES} SELECT {PROP}, overlapping, separable FROM q", ("claims",))
def _(spark, sf_dir):
    return C.temporal_conflicts(claims(spark, sf_dir)).where("overlapping + separable > 0")


@query(
    "inspect_contest_conflicts",
    f"""SELECT a.claim_id AS support_claim, b.claim_id AS attack_claim, a.lineage = b.lineage AND len(a.lineage) > 0 AS same_source, a.source_rid = b.source_rid AND a.extractor <> b.extractor AS same_artifact,
    NOT (coalesce(a.valid_to, 'infinity'::DOUBLE) < coalesce(b.valid_from, '-infinity'::DOUBLE) OR coalesce(b.valid_to, 'infinity'::DOUBLE) < coalesce(a.valid_from, '-infinity'::DOUBLE)) AS overlapping FROM claims a JOIN claims b USING ({PROP}) WHERE a.polarity = 1 AND b.polarity = -1 AND a.src = 's1' AND a.dst = 'p10'""",
    ("claims",),
)
def _(spark, sf_dir):
    # the three listings of one proposition: its own pairs are what is asked for
    return C.contest_pairs(claims(spark, sf_dir).where("src = 's1' and dst = 'p10'"))


@query(
    "interval_relations",
    f"""SELECT {PROP}, a.claim_id AS ea, b.claim_id AS eb, CASE WHEN a.valid_from = b.valid_from AND a.valid_to = b.valid_to THEN 'equals' WHEN abs(a.valid_to - b.valid_from) <= 0.5 THEN 'meets' WHEN abs(b.valid_to - a.valid_from) <= 0.5 THEN 'met_by' WHEN a.valid_to < b.valid_from THEN 'before' WHEN b.valid_to < a.valid_from THEN 'after'
    WHEN a.valid_from = b.valid_from AND a.valid_to < b.valid_to THEN 'starts' WHEN a.valid_from = b.valid_from AND a.valid_to > b.valid_to THEN 'started_by' WHEN a.valid_to = b.valid_to AND a.valid_from > b.valid_from THEN 'finishes' WHEN a.valid_to = b.valid_to AND a.valid_from < b.valid_from THEN 'finished_by'
    WHEN a.valid_from > b.valid_from AND a.valid_to < b.valid_to THEN 'during' WHEN a.valid_from < b.valid_from AND a.valid_to > b.valid_to THEN 'contains' WHEN a.valid_from < b.valid_from THEN 'overlaps' ELSE 'overlapped_by' END AS relation
    FROM claims a JOIN claims b USING ({PROP}, polarity) WHERE a.claim_id < b.claim_id AND a.valid_to IS NOT NULL AND b.valid_to IS NOT NULL""",
    ("claims",),
)
def _(spark, sf_dir):
    rows = claims(spark, sf_dir).where("valid_to is not null")
    a = rows.select(*KEY, "polarity", c("claim_id").alias("ea"), c("valid_from").alias("a0"), c("valid_to").alias("a1"))
    b = rows.select(*KEY, "polarity", c("claim_id").alias("eb"), c("valid_from").alias("b0"), c("valid_to").alias("b1"))
    return a.join(b, [*KEY, "polarity"]).where("ea < eb").select(*KEY, "ea", "eb", T.allen(c("a0"), c("a1"), c("b0"), c("b1")).alias("relation"))


@query(
    "interval_overlap_unknown",
    """SELECT claim_id, CASE WHEN f IS NULL THEN 'unknown' ELSE (f < 1e9 AND 9.5e8 < coalesce(t, 1.7976931348623157e308))::VARCHAR END AS overlaps, CASE WHEN f IS NULL THEN 'unknown' ELSE (9.2e8 < coalesce(t, 1.7976931348623157e308))::VARCHAR END AS overlaps_open
    FROM (SELECT claim_id, CASE WHEN modality <> 0 THEN valid_from END AS f, valid_to AS t FROM claims)""",
    ("claims",),
)
def _(spark, sf_dir):
    rows = claims(spark, sf_dir).withColumn("valid_from", F.when(c("modality") != 0, c("valid_from")))  # some begins are not known
    within = lambda a, b: T.overlap(c("valid_from"), c("valid_to"), F.lit(a), F.lit(b).cast("double"))
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    return rows.select("claim_id", shown(within(9.5e8, 1e9)).alias("overlaps"), shown(within(9.2e8, None)).alias("overlaps_open"))


@query(
    "move_type_profiles",
    """SELECT move_type, version, regime, count(*) AS uses, count(*) FILTER (done) AS resolved, count(*) FILTER (outcome = 'corroborated') AS corroborated, count(*) FILTER (outcome = 'retracted') AS retracted, count(*) FILTER (outcome = 'harmful_side_effect') AS harmful_side_effect,
    round(count(*) FILTER (outcome IN ('retracted', 'harmful_side_effect')) / count(*) FILTER (done)::DOUBLE, 6) AS contradiction_rate FROM (SELECT *, outcome IS NOT NULL OR created_at + horizon < 9e8 AS done FROM moves) GROUP BY 1, 2, 3""",
    ("moves",),
)
def _(spark, sf_dir):
    return V.profiles(A.moves(spark, sf_dir), 9e8).withColumn("contradiction_rate", F.round("contradiction_rate", 6))


@query("moves_consuming_claims", "SELECT claim_id, count(DISTINCT move_id) AS moves FROM move_io WHERE role = 'input' GROUP BY 1", ("move_io",))
def _(spark, sf_dir):
    return V.consuming(A.move_io(spark, sf_dir))


@query("load_bearing", f"SELECT {PROP}, count(DISTINCT move_id) AS load FROM claims LEFT JOIN (SELECT * FROM move_io WHERE role = 'input') USING (claim_id) GROUP BY {PROP}", ("claims", "move_io"))
def _(spark, sf_dir):
    return V.load(A.move_io(spark, sf_dir), claims(spark, sf_dir))


_FIXED = """fixed AS (SELECT move_id, [NULL, 'analogy', 'compression'][1 + (move_id * 3 + seen) % 3] AS move_type, CASE WHEN (move_id + seen) % 2 = 0 THEN 'v9' END AS version, CASE WHEN seen = 2 THEN 'audit' END AS regime, seen FROM moves, (SELECT unnest([1, 2, 3]) AS seen) WHERE move_id % 5 = 0)"""


def corrections(spark, sf_dir):
    m = A.moves(spark, sf_dir).where("move_id % 5 = 0").select("move_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("at"))
    kind = F.element_at(F.array(F.lit(None).cast("string"), F.lit("analogy"), F.lit("compression")), ((c("move_id") * 3 + c("at")) % 3 + 1).cast("int"))
    return m.select("move_id", kind.alias("move_type"), F.when((c("move_id") + c("at")) % 2 == 0, "v9").alias("version"), F.when(c("at") == 2, "audit").alias("regime"), "at")


@query(
    "move_canonical",
    f"""WITH {_FIXED}, n AS (SELECT move_id, arg_max(move_type, seen) FILTER (move_type IS NOT NULL) AS t, arg_max(version, seen) FILTER (version IS NOT NULL) AS v, arg_max(regime, seen) FILTER (regime IS NOT NULL) AS r FROM fixed GROUP BY 1)
    SELECT move_id, coalesce(t, move_type) AS move_type, coalesce(v, version) AS version, coalesce(r, regime) AS regime FROM moves LEFT JOIN n USING (move_id)""",
    ("moves",),
)
def _(spark, sf_dir):
    return V.canonical(A.moves(spark, sf_dir), corrections(spark, sf_dir)).select("move_id", "move_type", "version", "regime")


@query("composition_axioms", "SELECT l.move_id AS \"left\", r.move_id AS \"right\", CASE l.move_type WHEN 'decomposition' THEN 'decompose_aggregate_identity' ELSE 'negate_analogize_non_commutative' END AS axiom FROM moves l JOIN moves r ON r.move_id = l.move_id + 1 WHERE (l.move_type = 'decomposition' AND r.move_type = 'aggregate_back') OR (l.move_type = 'negate_and_test' AND r.move_type = 'analogy')", ("moves",))
def _(spark, sf_dir):
    m = A.moves(spark, sf_dir)
    return V.composition_axioms(m.select(c("move_id").alias("left"), (c("move_id") + 1).alias("right")), m)


@query(
    "self_gen_ancestry",
    f"""WITH b AS (SELECT DISTINCT o.claim_id AS made, i.claim_id FROM move_io o JOIN move_io i USING (move_id) WHERE o.role = 'output' AND i.role = 'input'), a AS (SELECT DISTINCT {PROP}, b.claim_id FROM claims c JOIN b ON b.made = c.claim_id),
    z AS (SELECT DISTINCT {PROP}, b.claim_id FROM a JOIN b ON b.made = a.claim_id), t AS (SELECT * FROM a UNION SELECT * FROM z), s AS (SELECT t.src, t.rel, t.dst, t.namespace, avg(coalesce(c.self_generated, false)::INT) AS ancestral FROM t LEFT JOIN claims c USING (claim_id) GROUP BY 1, 2, 3, 4)
    SELECT {PROP}, round(coalesce(ancestral, 0), 6) AS ancestral FROM (SELECT DISTINCT {PROP} FROM claims) LEFT JOIN s USING ({PROP})""",
    ("claims", "move_io"),
)
def _(spark, sf_dir):
    return V.ancestry(A.move_io(spark, sf_dir), claims(spark, sf_dir)).withColumn("ancestral", F.round("ancestral", 6))


@query(
    "move_preconditions",
    f"""{CONTEST}, k AS (SELECT unnest(['source_audit', 'compression', 'hypothesis_generation', 'analogy']) AS move_type)
    SELECT {PROP}, move_type, CASE move_type WHEN 'source_audit' THEN 'source_audit_requires_external_ancestry' WHEN 'compression' THEN 'compression_requires_support' ELSE 'hypothesis_generation_skips_present_tense_conflict' END AS axiom FROM f, k WHERE move_type = 'source_audit' OR (move_type = 'compression' AND support <= 0) OR (move_type = 'hypothesis_generation' AND overlapping > 0)""",
    ("claims",),
)
def _(spark, sf_dir):
    # no ancestry has been computed here, which an audit of sources doesn't accept
    kinds = F.array(*map(F.lit, ("source_audit", "compression", "hypothesis_generation", "analogy")))
    asked = C.contest_state(claims(spark, sf_dir)).select(*KEY, "support", "flags", F.lit(None).cast("double").alias("ancestral"), F.explode(kinds).alias("move_type"))
    return V.violations(asked).select(*KEY, "move_type", "axiom")


@query("adversarial_candidates", f"{CONTEST} SELECT DISTINCT move_id, 'contradiction' AS found_by, 'candidate' AS status FROM move_io JOIN claims USING (claim_id) JOIN f USING ({PROP}) WHERE role = 'output' AND flags & ~2 <> 0 AND move_id % 4 <> 0", ("claims", "move_io"))
def _(spark, sf_dir):
    # before: nothing but shared sources was known; some moves are filed already
    after = C.contest_state(claims(spark, sf_dir)).select(*KEY, "flags")
    io = A.move_io(spark, sf_dir)
    filed = io.where("move_id % 4 = 0").select("move_id", F.lit("contradiction").alias("found_by"))
    return V.auto_file(after.withColumn("flags", F.lit(2).cast("long")), after, claims(spark, sf_dir), io, filed)


@query("policy_fallback", "SELECT DISTINCT namespace, CASE namespace WHEN 'ns0' THEN 'strict' ELSE 'lenient' END AS policy FROM claims", ("claims",))
def _(spark, sf_dir):
    policies = spark.createDataFrame([("ns0", "strict"), ("*", "lenient")], "pns string, policy string")
    rows = claims(spark, sf_dir).select("namespace").distinct()
    own, common = policies.where("pns <> '*'").select(c("pns").alias("namespace"), c("policy").alias("own")), policies.where("pns = '*'").select(c("policy").alias("common"))
    return rows.join(own, "namespace", "left").crossJoin(common).select("namespace", F.coalesce("own", "common").alias("policy"))  # common is one row
