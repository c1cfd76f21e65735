"""A memory store: append-only Parquet tables under one path, read through latest-wins views.

Writes append versions; nothing is updated in place, so concurrent writers and lost executors leave whole files only.
A tenant is a path of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engrama.functions.security import Clock
from engrama.operators.memory import latest

VERSION = 1
CLOCK = ["ms", "counter", "node"]
_CLOCK = "ms long, counter int, node long"
#: Each table's columns (without the clock) and key.
TABLES = {
    "memories": ("rid string, type string, text string, importance double, valence double, half_life double, created_at double, last_access double, access_count long, status string, storage_tier string, namespace string, domain string, source string, certainty double, session_id string, due_at double, metadata string, embedding array<float>", ["rid"]),
    "edges": ("src string, rel string, dst string, weight double, created_at double, status string, namespace string", ["src", "rel", "dst", "namespace"]),
    "claims": ("src string, rel string, dst string, extractor string, polarity int, namespace string, valid_from double, valid_to double, lineage array<string>, modality string, self_generated boolean, weight double, status string", ["src", "rel", "dst", "extractor", "polarity", "namespace"]),
    "links": ("rid string, entity string", ["rid", "entity"]),
    "sessions": ("session_id string, client string, namespace string, started_at double, ended_at double, status string, summary string", ["session_id"]),
    "oplog": ("op_id string, op_type string, target string, payload string, actor string, hash string", ["op_id"]),
    "triggers": ("trigger_id string, kind string, urgency double, status string, expires_at double, cooldown_key string", ["trigger_id"]),
    "patterns": ("pattern string, dedup_key string, confidence double, occurrences long, status string, last_confirmed double", ["pattern", "dedup_key"]),
    "feedback": ("query_text string, rid string, relevant boolean, score double, rank int, at double", ["query_text", "rid"]),
    "aliases": ("alias string, namespace string, entity string, source string", ["alias", "namespace"]),
    "conflicts": ("conflict_id string, type string, priority string, status string, memory_a string, memory_b string, entity string, rel string, detected_at double, reason string, resolution string, note string", ["conflict_id"]),
    "categories": ("category string, member string, confidence double, source string, status string", ["category", "member"]),
    "watermarks": ("peer string, op_id string", ["peer"]),
    "weights": ("name string, sim double, decay double, recency double, tau double, alpha double, generation long", ["name"]),
    "tenants": ("name string, path string, created_at double", ["name"]),
}
#: How pressing a conflict of each type is, and when nobody needs to be asked.
PRIORITY = {"identity_fact": "critical", "preference": "high", "temporal": "high", "consolidation": "medium", "minor": "low"}
RANKS = ["critical", "high", "medium", "low"]
DEFAULTS = {"type": "episodic", "importance": 0.5, "valence": 0.0, "half_life": 604800.0, "access_count": 0, "status": "active", "storage_tier": "hot", "namespace": "default", "domain": "general", "source": "user", "certainty": 0.8}


class Store:
    """open(): Store(spark, path). Every write takes `now`, in seconds."""

    def __init__(self, spark: SparkSession, path: str, actor: str = "local", node: int = 0):
        self.spark, self.path, self.actor = spark, path.rstrip("/"), actor
        self.clock = Clock(0, 0, node)
        meta = f"{self.path}/meta"
        if self._exists(meta):
            found = spark.read.json(meta).agg(F.max("version")).first()[0]
            if found > VERSION:
                raise ValueError(f"the store has version {found}, newer than {VERSION}")
        else:
            spark.range(1).select(F.lit(VERSION).alias("version")).write.json(meta)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(f"{TABLES[table][0]}, {_CLOCK}")

    def versions(self, table: str) -> DataFrame:
        path = f"{self.path}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(path)

    def view(self, table: str) -> DataFrame:
        """The latest version of each row."""
        return latest(self.versions(table), TABLES[table][1], CLOCK)

    def append(self, table: str, rows: DataFrame, now: float) -> None:
        """Append versions under one new clock reading; absent columns become null."""
        self.clock = self.clock.tick(int(now * 1000))
        have = set(rows.columns)
        cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(table) if f.name not in CLOCK]
        stamped = rows.select(*cols).select("*", F.lit(self.clock.ms).cast("long").alias("ms"), F.lit(self.clock.counter).cast("int").alias("counter"), F.lit(self.clock.node).cast("long").alias("node"))
        stamped.write.mode("append").parquet(f"{self.path}/{table}")

    def log(self, op_type: str, target: str, payload: dict, now: float) -> None:
        text = json.dumps(payload, sort_keys=True)
        self.clock = self.clock.tick(int(now * 1000))
        row = [(self.clock.to_bytes().hex(), op_type, target, text, self.actor)]
        rows = self.spark.createDataFrame(row, "op_id string, op_type string, target string, payload string, actor string")
        self.append("oplog", rows.withColumn("hash", F.sha2(F.concat_ws("|", "op_type", "target", "payload"), 256)), now)

    # memories

    def record_batch(self, rows: DataFrame, now: float) -> None:
        """Append memories in one job; rids come from a hash of the text and the clock where absent."""
        from engrama.functions.text import proper_nouns

        have = set(rows.columns)
        if "rid" not in have:
            rows = rows.withColumn("rid", F.sha2(F.concat_ws("|", F.lit(str(now)), "text", F.monotonically_increasing_id().cast("string")), 256))
        for k, v in DEFAULTS.items():
            rows = rows.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v))
        for k in ("created_at", "last_access"):
            rows = rows.withColumn(k, F.coalesce(F.col(k), F.lit(float(now))) if k in have else F.lit(float(now)))
        self.append("memories", rows, now)
        self.append("links", rows.select("rid", F.explode(proper_nouns(F.col("text"))).alias("entity")), now)

    def record(self, text: str, now: float, **fields) -> str:
        import hashlib

        rid = fields.pop("rid", None) or hashlib.sha256(f"{now}|{text}|{self.clock}".encode()).hexdigest()[:32]
        row = {"rid": rid, "text": text, **fields}
        shape = T.StructType([f for f in self.schema("memories") if f.name in row])
        self.record_batch(self.spark.createDataFrame([tuple(row[f.name] for f in shape)], shape), now)
        self.log("record", rid, {"text": text}, now)
        return rid

    def get(self, rid: str) -> dict | None:
        row = latest(self.versions("memories").where(F.col("rid") == rid), ["rid"], CLOCK).first()
        return row.asDict() if row else None

    def _revise(self, rid: str, now: float, **changes) -> bool:
        one = latest(self.versions("memories").where(F.col("rid") == rid), ["rid"], CLOCK).drop(*CLOCK)
        if one.isEmpty():
            return False
        self.append("memories", one.withColumns({k: F.lit(v) if not hasattr(v, "alias") else v for k, v in changes.items()}), now)
        return True

    def forget(self, rid: str, now: float) -> bool:
        ok = self._revise(rid, now, status="tombstoned")
        if ok:
            self.log("forget", rid, {}, now)
        return ok

    def correct(self, rid: str, text: str, now: float) -> str | None:
        """Record the corrected text with the old row's settings and tombstone the old row."""
        old = self.get(rid)
        if old is None:
            return None
        keep = {k: old[k] for k in ("type", "importance", "valence", "half_life", "namespace", "domain", "source", "certainty") if old[k] is not None}
        new = self.record(text, now, **keep)
        self._revise(rid, now, status="tombstoned")
        self.log("correct", rid, {"new": new}, now)
        return new

    def reinforce(self, rid: str, now: float) -> bool:
        grown = F.least(F.col("half_life") * 1.2, F.lit(31536000.0))
        return self._revise(rid, now, half_life=grown, last_access=float(now), access_count=F.col("access_count") + 1)

    def archive(self, rid: str, now: float) -> bool:
        return self._revise(rid, now, storage_tier="cold")

    def hydrate(self, rid: str, now: float) -> bool:
        return self._revise(rid, now, storage_tier="hot")

    # graph, sessions, feedback

    def relate(self, src: str, rel: str, dst: str, now: float, weight: float = 1.0, namespace: str = "default") -> None:
        rows = self.spark.createDataFrame([(src, rel, dst, weight, float(now), "active", namespace)], "src string, rel string, dst string, weight double, created_at double, status string, namespace string")
        self.append("edges", rows, now)
        self.log("relate", src, {"rel": rel, "dst": dst, "weight": weight}, now)

    def session_start(self, client: str, now: float, namespace: str = "default") -> str:
        """Open a session; an error if the client has an active one in the namespace."""
        busy = self.view("sessions").where((F.col("client") == client) & (F.col("namespace") == namespace) & (F.col("status") == "active"))
        if not busy.isEmpty():
            raise ValueError(f"{client} has an active session")
        sid = f"{namespace}-{client}-{int(now * 1000)}"
        self.append("sessions", self.spark.createDataFrame([(sid, client, namespace, float(now), "active")], "session_id string, client string, namespace string, started_at double, status string"), now)
        return sid

    def session_end(self, session_id: str, now: float, summary: str = "") -> dict | None:
        one = self.view("sessions").where(F.col("session_id") == session_id).drop(*CLOCK)
        if one.isEmpty():
            return None
        self.append("sessions", one.withColumns({"status": F.lit("ended"), "ended_at": F.lit(float(now)), "summary": F.lit(summary)}), now)
        g = self.view("memories").where(F.col("session_id") == session_id).agg(F.count("*").alias("memories"), F.avg("valence").alias("valence")).first()
        return {"memories": g["memories"], "valence": g["valence"], "seconds": now - one.first()["started_at"]}

    def recall_feedback(self, query_text: str, rid: str, relevant: bool, score: float, rank: int, now: float) -> None:
        self.append("feedback", self.spark.createDataFrame([(query_text, rid, relevant, score, rank, float(now))], "query_text string, rid string, relevant boolean, score double, rank int, at double"), now)

    # claims, aliases, links

    def link_memory_entity(self, rid: str, entity: str, now: float) -> None:
        self.append("links", self.spark.createDataFrame([(rid, entity)], "rid string, entity string"), now)

    def add_entity_alias(self, alias: str, entity: str, now: float, namespace: str = "*", source: str = "user") -> bool:
        """Whether the alias is new; one that stands for itself is refused."""
        if alias == entity:
            return False
        known = not self.view("aliases").where((F.col("alias") == alias) & (F.col("namespace") == namespace) & (F.col("entity") == entity)).isEmpty()
        if not known:
            self.append("aliases", self.spark.createDataFrame([(alias, namespace, entity, source)], "alias string, namespace string, entity string, source string"), now)
        return not known

    def resolve_alias(self, name: str, namespace: str = "*") -> str:
        """The namespace's meaning of a name, else the common one, else the name itself."""
        found = {r["namespace"]: r["entity"] for r in self.view("aliases").where((F.col("alias") == name) & F.col("namespace").isin(namespace, "*")).collect()}
        return found.get(namespace, found.get("*", name))

    def ingest_claim(self, src: str, rel: str, dst: str, now: float, polarity: int = 1, extractor: str = "user", namespace: str = "default", **fields) -> dict:
        """Write a claim over resolved names, latest wins on its key; gives the proposition's contest state after it."""
        from engrama.operators import claims as C

        src, dst = self.resolve_alias(src, namespace), self.resolve_alias(dst, namespace)
        row = {"src": src, "rel": rel, "dst": dst, "extractor": extractor, "polarity": polarity, "namespace": namespace, "lineage": [], "modality": "asserted", "self_generated": False, "weight": 1.0, "status": "active", **fields}
        shape = T.StructType([f for f in self.schema("claims") if f.name in row])
        row["lineage"] = sorted({x.strip().lower() for x in row["lineage"] if x.strip()})
        self.append("claims", self.spark.createDataFrame([tuple(row[f.name] for f in shape)], shape), now)
        self.log("claim", f"{src}|{rel}|{dst}", {"polarity": polarity, "extractor": extractor, "namespace": namespace}, now)
        return C.contest_state(self.proposition(src, rel, dst, namespace)).drop("src", "rel", "dst", "namespace").first().asDict()

    def proposition(self, src: str, rel: str, dst: str, namespace: str = "default") -> DataFrame:
        """The live claims of one proposition, as operators.claims takes them."""
        rows = self.view("claims").where((F.col("src") == src) & (F.col("rel") == rel) & (F.col("dst") == dst) & (F.col("namespace") == namespace) & (F.col("status") == "active"))
        return rows.withColumn("claim_id", F.concat_ws("/", "extractor", "polarity")).withColumn("source_rid", F.lit(None).cast("string")).withColumn("created_at", F.col("ms") / 1000)

    # conflicts and categories

    def create_conflict(self, type: str, memory_a: str, memory_b: str, now: float, entity: str | None = None, rel: str | None = None, reason: str = "") -> str | None:  # noqa: A002
        """Open a conflict between two memories; None where one of them, of either order, is there already."""
        import hashlib

        a, b = sorted((memory_a, memory_b))
        key = hashlib.sha256(f"{a}|{b}|{entity or ''}|{rel or ''}".encode()).hexdigest()[:32]
        if self.get_conflict(key):
            return None
        row = (key, type, PRIORITY.get(type, "low"), "open", memory_a, memory_b, entity, rel, float(now), reason)
        self.append("conflicts", self.spark.createDataFrame([row], "conflict_id string, type string, priority string, status string, memory_a string, memory_b string, entity string, rel string, detected_at double, reason string"), now)
        self.log("conflict", key, {"type": type, "a": memory_a, "b": memory_b}, now)
        return key

    def get_conflict(self, conflict_id: str) -> dict | None:
        row = latest(self.versions("conflicts").where(F.col("conflict_id") == conflict_id), ["conflict_id"], CLOCK).first()
        return row.asDict() if row else None

    def get_conflicts(self, limit: int = 50, **only) -> DataFrame:
        """Conflicts by the given status, type, priority or entity: the most pressing first, then the newest."""
        rows = self.view("conflicts")
        for name, value in only.items():
            if value is not None:
                rows = rows.where(F.col(name) == value)
        place = F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), F.col("priority")), F.lit(0))
        return rows.orderBy(F.when(place == 0, len(RANKS) + 1).otherwise(place), F.desc("detected_at"), "conflict_id").limit(limit).drop(*CLOCK)

    def detect_edge_conflicts(self, src: str, rel: str, dst: str, now: float, rid: str | None = None) -> list[str]:
        """Open a conflict for every other object of a relation that a subject has only one of."""
        from engrama.functions.text import IDENTITY, PREFERENCE

        if rel not in (*IDENTITY, *PREFERENCE):
            return []
        others = self.view("edges").where((F.col("src") == src) & (F.col("rel") == rel) & (F.col("dst") != dst) & F.coalesce(F.col("status") != "tombstoned", F.lit(True))).orderBy("dst")
        kind = "identity_fact" if rel in IDENTITY else "preference"
        found = [self.create_conflict(kind, rid or dst, r["dst"], now, entity=src, rel=rel, reason=f"{src} {rel} {r['dst']} and {dst}") for r in others.collect()]  # as many as one subject's objects
        return [k for k in found if k]

    def _settle(self, conflict_id: str, now: float, **changes) -> bool:
        one = latest(self.versions("conflicts").where(F.col("conflict_id") == conflict_id), ["conflict_id"], CLOCK).drop(*CLOCK)
        if one.isEmpty():
            return False
        self.append("conflicts", one.withColumns({k: F.lit(v) for k, v in changes.items()}), now)
        return True

    def resolve_conflict(self, conflict_id: str, strategy: str, now: float, text: str | None = None, note: str | None = None) -> bool:
        """keep_a, keep_b, keep_both or merge (a new memory of `text`); memories that lose are tombstoned."""
        found = self.get_conflict(conflict_id)
        if not found or found["status"] != "open" or strategy not in ("keep_a", "keep_b", "keep_both", "merge") or strategy == "merge" and not text:
            return False
        lose = {"keep_a": ["memory_b"], "keep_b": ["memory_a"], "keep_both": [], "merge": ["memory_a", "memory_b"]}[strategy]
        new = self.record(text, now) if strategy == "merge" else None
        for side in lose:
            self.forget(found[side], now)
        self.log("conflict_resolve", conflict_id, {"strategy": strategy, "new": new}, now)
        return self._settle(conflict_id, now, status="resolved", resolution=strategy, note=note)

    def dismiss_conflict(self, conflict_id: str, now: float, note: str | None = None) -> bool:
        return self._settle(conflict_id, now, status="dismissed", note=note)

    def reclassify_conflict(self, conflict_id: str, type: str, now: float) -> dict:  # noqa: A002
        """Give a conflict another type; the words that tell its two texts apart become members of one category."""
        found = self.get_conflict(conflict_id)
        if not found or type not in PRIORITY:
            raise ValueError("no such conflict or type")
        words = [set((self.get(found[k]) or {"text": ""})["text"].lower().split()) for k in ("memory_a", "memory_b")]
        apart = sorted(words[0] - words[1]), sorted(words[1] - words[0])
        learned = 0
        if all(len(x) == 1 for x in apart) and type != "minor":
            learned = self.learn_category_members(f"learned_{found['rel'] or type}", [(apart[0][0], 0.6), (apart[1][0], 0.6)], "user", now)
        self._settle(conflict_id, now, type=type, priority=PRIORITY[type])
        return {"type": type, "learned": learned}

    def learn_category_members(self, category: str, members: list[tuple[str, float]], source: str, now: float) -> int:
        """Add members to a category, which need not exist; what a language model suggests waits for approval."""
        known = {r["member"] for r in self.view("categories").where(F.col("category") == category).collect()}
        status = "pending" if source == "llm_suggested" else "active"
        new = [(category, m.strip().lower(), float(p), source, status) for m, p in members if m.strip() and m.strip().lower() not in known]
        if new:
            self.append("categories", self.spark.createDataFrame(new, "category string, member string, confidence double, source string, status string"), now)
        return len(new)

    def reset_category_to_seed(self, category: str, now: float) -> int:
        """Retire the members that were learned; the seeds stay."""
        rows = self.view("categories").where((F.col("category") == category) & (F.col("source") != "seed") & (F.col("status") != "retired")).drop(*CLOCK)
        n = rows.count()
        if n:
            self.append("categories", rows.withColumn("status", F.lit("retired")), now)
        return n

    def substitution_members(self, category: str) -> list[str]:
        return [r["member"] for r in self.view("categories").where((F.col("category") == category) & (F.col("status") == "active")).orderBy(F.desc("confidence"), "member").collect()]

    # triggers, patterns, learning

    def persist_triggers(self, found: DataFrame, now: float, cooldown: float = 86400.0) -> int:
        """Write triggers (kind, urgency, cooldown_key, days) unless one of their key is pending or came within the cooldown."""
        recent = self.view("triggers").where((F.col("status") == "pending") | (F.col("ms") / 1000 > now - cooldown)).select("cooldown_key").distinct()
        new = found.dropDuplicates(["cooldown_key"]).join(recent, "cooldown_key", "left_anti")
        new = new.select(F.sha2(F.concat_ws("|", "cooldown_key", F.lit(str(now))), 256).alias("trigger_id"), "kind", "urgency", F.lit("pending").alias("status"), (F.lit(float(now)) + 86400.0 * F.col("days")).alias("expires_at"), "cooldown_key")
        n = new.count()
        if n:
            self.append("triggers", new, now)
        return n

    def expire_triggers(self, now: float) -> int:
        rows = self.view("triggers").where((F.col("status") == "pending") & (F.col("expires_at") < now)).drop(*CLOCK)
        n = rows.count()
        if n:
            self.append("triggers", rows.withColumn("status", F.lit("expired")), now)
        return n

    def move_trigger(self, trigger_id: str, status: str, now: float) -> bool:
        """Deliver, acknowledge, act on or dismiss: each only from the states before it."""
        before = {"delivered": ["pending"], "acknowledged": ["delivered"], "acted": ["delivered", "acknowledged"], "dismissed": ["pending", "delivered", "acknowledged"]}
        one = self.view("triggers").where((F.col("trigger_id") == trigger_id) & F.col("status").isin(*before.get(status, []))).drop(*CLOCK)
        if one.isEmpty():
            return False
        self.append("triggers", one.withColumn("status", F.lit(status)), now)
        return True

    def get_pending_triggers(self, limit: int = 10) -> DataFrame:
        return self.view("triggers").where("status = 'pending'").orderBy(F.desc("urgency"), "trigger_id").limit(limit).drop(*CLOCK)

    def get_trigger_history(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        """The newest triggers in any state."""
        first = self.versions("triggers").groupBy("trigger_id").agg(F.min("ms").alias("born"))
        rows = self.view("triggers").join(first, "trigger_id")
        return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(F.desc("born"), "trigger_id").limit(limit).drop(*CLOCK)

    def upsert_patterns(self, found: DataFrame, now: float) -> tuple[int, int]:
        """Patterns (pattern, dedup_key, confidence): (new, seen again); one seen again counts up and keeps its best confidence."""
        known = self.view("patterns").select("pattern", "dedup_key", F.col("confidence").alias("old"), F.col("occurrences").alias("times"))
        rows = found.dropDuplicates(["pattern", "dedup_key"]).join(known, ["pattern", "dedup_key"], "left")
        rows = rows.select("pattern", "dedup_key", F.greatest("confidence", "old").alias("confidence"), (F.coalesce("times", F.lit(0)) + 1).alias("occurrences"), F.lit("active").alias("status"), F.lit(float(now)).alias("last_confirmed"))
        new, every = rows.agg(F.count_if(F.col("occurrences") == 1), F.count("*")).first()
        if every:
            self.append("patterns", rows, now)
        return new, every - new

    def get_patterns(self, pattern: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.view("patterns")
        for name, value in (("pattern", pattern), ("status", status)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy(F.desc("confidence"), "pattern", "dedup_key").limit(limit).drop(*CLOCK)

    def load_learned_weights(self):
        """The weights learned last, else the defaults."""
        from engrama.functions.scoring import Weights

        row = self.view("weights").first()
        return Weights(**{k: row[k] for k in ("sim", "decay", "recency", "tau", "alpha")}) if row else Weights()

    def run_learning(self, now: float) -> bool:
        """Learn from the feedback; whether the weights got better and were written."""
        from engrama.operators.cognition import learn_weights

        before = self.view("weights").first()
        new = learn_weights(self.view("feedback"), self.view("memories"), self.load_learned_weights(), now)
        if new is None:
            return False
        row = [("learned", new.sim, new.decay, new.recency, new.tau, new.alpha, (before["generation"] if before else 0) + 1)]
        self.append("weights", self.spark.createDataFrame(row, TABLES["weights"][0]), now)
        return True

    def record_procedural(self, text: str, now: float, effectiveness: float = 0.5, **fields) -> str:
        """A way to do something: its effectiveness is its importance and certainty, and it fades over four weeks."""
        return self.record(text, now, type="procedural", importance=effectiveness, certainty=effectiveness, half_life=4 * 604800.0, **fields)

    def think(self, now: float, importance: float = 0.5, decay: float = 0.1, least_active: int = 10, most: int = 10) -> dict:
        """One round of maintenance: expire triggers, look for new ones and for conflicts, mine patterns, learn, and persist."""
        from engrama.operators import memory as M
        from engrama.operators import patterns as P

        expired = self.expire_triggers(now)
        active = M.with_decay(M.active(self.view("memories")), now)
        row = lambda rows, kind, urgency, key, days: rows.select(F.lit(kind).alias("kind"), urgency.alias("urgency"), F.concat_ws(":", F.lit(kind), key).alias("cooldown_key"), F.lit(days).alias("days"))
        fading = active.where((F.col("importance") >= importance) & (F.col("decay") < decay))
        triggers = row(fading, "decay_review", F.col("importance") - F.col("decay"), F.col("rid"), 7)
        many = active.where("type = 'episodic'").agg(F.count("*").alias("n")).where(F.col("n") >= least_active)
        triggers = triggers.unionByName(row(many, "consolidation_ready", F.least(F.lit(1.0), F.col("n") / 50), F.lit("all"), 3))
        triggers = triggers.unionByName(row(P.temporal_drift(active, now), "temporal_drift", F.col("urgency"), F.col("rid"), 14))
        shift = P.valence_shift(active, now, 7, 37)
        triggers = triggers.unionByName(row(shift, "valence_trend", F.least(F.lit(1.0), F.abs("delta")), F.lit("all"), 7))
        conflicts = self.get_conflicts(status="open", limit=1000)
        pressing = conflicts.agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "critical").alias("critical")).where("n > 5 or critical > 0")
        triggers = triggers.unionByName(row(pressing, "conflict_escalation", F.least(F.lit(1.0), F.col("n") / 10 + F.when(F.col("critical") > 0, 0.5).otherwise(0.0)), F.lit("open"), 3))
        hubs = self.view("edges").groupBy("src").agg(F.count("*").alias("n")).where("n >= 5")
        triggers = triggers.unionByName(row(hubs, "relationship_insight", F.least(F.lit(1.0), F.col("n") / 20), F.col("src"), 7))

        found = self.view("links").join(active.select("rid", "domain", "status"), "rid").drop("domain", "status", *CLOCK)
        bridges = P.bridges(found, active).select(F.lit("entity_bridge").alias("pattern"), F.col("entity").alias("dedup_key"), "confidence")
        new, again = self.upsert_patterns(bridges, now)
        if new:
            told = self.get_patterns(status="active", limit=10)
            triggers = triggers.unionByName(row(told, "entity_bridge_discovered", F.greatest(0.7 * F.col("confidence"), F.lit(0.4)), F.col("dedup_key"), 7))
        learned = self.run_learning(now)
        if learned:
            triggers = triggers.unionByName(row(self.spark.range(1), "weights_updated", F.lit(0.3), F.lit(str(now)), 7))
        last = self.view("sessions").where("status = 'ended'").orderBy(F.desc("ended_at")).limit(1).withColumn("gap", (now - F.col("ended_at")) / 3600).where("gap > 4")
        triggers = triggers.unionByName(row(last, "session_awareness", F.when(F.col("gap") > 72, 0.7).when(F.col("gap") > 24, 0.5).otherwise(0.3), F.col("session_id"), 3))
        best = triggers.orderBy(F.desc("urgency"), "cooldown_key")
        written = self.persist_triggers(best, now)
        told = self.get_pending_triggers(most).collect()
        self.log("think", "", {"triggers": written, "patterns": new}, now)
        return {"expired": expired, "triggers": [r.asDict() for r in told], "conflicts": conflicts.count(), "patterns_new": new, "patterns_updated": again, "learned": learned}

    # replication, export

    def ops_since(self, mark: str = "", exclude: str | None = None, limit: int | None = None) -> DataFrame:
        """Operations after a watermark (an op_id; they sort by clock)."""
        rows = self.versions("oplog").where(F.col("op_id") > mark)
        if exclude is not None:
            rows = rows.where(F.col("actor") != exclude)
        rows = rows.orderBy("op_id")
        return rows.limit(limit) if limit else rows

    def apply_ops(self, ops: DataFrame, now: float) -> int:
        """Apply operations that aren't known yet; the fold doesn't depend on their order."""
        fresh = ops.join(self.versions("oplog").select("op_id"), "op_id", "left_anti").dropDuplicates(["op_id"])
        fresh.select(*[f.name for f in self.schema("oplog")]).write.mode("append").parquet(f"{self.path}/oplog")
        mine = self.versions("oplog").join(ops.select("op_id").distinct(), "op_id", "left_semi")
        told = mine.where("op_type = 'record'").select(F.col("target").alias("rid"), F.get_json_object("payload", "$.text").alias("text")).join(self.versions("memories").select("rid").distinct(), "rid", "left_anti").dropDuplicates(["rid"])
        if not told.isEmpty():
            self.record_batch(told, now)
        gone = self.versions("oplog").where("op_type in ('forget', 'correct')").select(F.col("target").alias("rid")).distinct()
        dead = self.view("memories").where("status <> 'tombstoned'").join(gone, "rid", "left_semi").drop(*CLOCK)
        if not dead.isEmpty():
            self.append("memories", dead.withColumn("status", F.lit("tombstoned")), now)
        return mine.count()

    def set_peer_watermark(self, peer: str, op_id: str, now: float) -> None:
        self.append("watermarks", self.spark.createDataFrame([(peer, op_id)], "peer string, op_id string"), now)

    def get_peer_watermark(self, peer: str) -> str:
        row = self.view("watermarks").where(F.col("peer") == peer).first()
        return row["op_id"] if row else ""

    def sync(self, other: "Store", now: float) -> tuple[int, int]:
        """Exchange operations with another store both ways, from what either has seen of the other: (received, sent)."""
        done = []
        for to, frm in ((self, other), (other, self)):
            ops = frm.ops_since(to.get_peer_watermark(frm.actor), exclude=to.actor)
            top = ops.agg(F.max("op_id")).first()[0]
            before = to.versions("oplog").count()
            if top:
                to.apply_ops(ops, now)
                to.set_peer_watermark(frm.actor, top, now)
            done.append(to.versions("oplog").count() - before)
        return done[0], done[1]

    def export(self, path: str, embeddings: bool = False) -> None:
        """Every table's current rows as JSON lines."""
        for t in TABLES:
            rows = self.view(t)
            (rows if embeddings else rows.drop("embedding")).write.mode("overwrite").json(f"{path}/{t}")

    def import_(self, path: str, now: float) -> None:
        """Rows of an export whose keys aren't here yet."""
        for t, (_, key) in TABLES.items():
            if self._exists(f"{path}/{t}"):
                rows = self.spark.read.schema(self.schema(t)).json(f"{path}/{t}").drop(*CLOCK)
                self.append(t, rows.join(self.versions(t).select(*key).distinct(), key, "left_anti"), now)


def register_tenant(registry: Store, name: str, path: str, now: float) -> bool:
    """Note a tenant's store in a registry store; False where the name is taken by another path."""
    found = registry.view("tenants").where(F.col("name") == name).first()
    if found:
        return found["path"] == path
    registry.append("tenants", registry.spark.createDataFrame([(name, path, float(now))], TABLES["tenants"][0]), now)
    return True


def tenants(spark: SparkSession, root: str) -> list[str]:
    """The names of stores under a root path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
