"""Queries of event and temporal analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.operators import events as E
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col


def ev(spark, sf_dir):
    return A.events(spark, sf_dir)


@query("event_predicates", "SELECT event_id, user_id, kind FROM ev WHERE kind IN ('error', 'purchase') AND t BETWEEN 1704500000 AND 1705500000 AND k < 50", ("ev",))
def _(spark, sf_dir):
    return ev(spark, sf_dir).where(c("kind").isin("error", "purchase") & c("t").between(1704500000, 1705500000) & (c("k") < 50)).select("event_id", "user_id", "kind")


@query("events_in_window", "SELECT event_id, t FROM ev WHERE t BETWEEN 1704500000 AND 1704600000 ORDER BY t DESC, event_id", ("ev",))
def _(spark, sf_dir):
    return ev(spark, sf_dir).where(c("t").between(1704500000, 1704600000)).orderBy(F.desc("t"), "event_id").select("event_id", "t")


@query("event_counters", "SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY kind", ("ev",))
def _(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("hour_histogram", "SELECT kind, CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("kind", F.floor(F.pmod(c("t"), F.lit(86400.0)) / 3600).alias("hour")).agg(F.count("*").alias("n"))


@query("peak_hour", "SELECT kind, max_by(hour, struct_pack(a := n, b := hour)) AS peak FROM (SELECT kind, CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY kind", ("ev",))
def _(spark, sf_dir):
    h = ev(spark, sf_dir).groupBy("kind", F.floor(F.pmod(c("t"), F.lit(86400.0)) / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return h.groupBy("kind").agg(F.max_by("hour", F.struct("n", "hour")).alias("peak"))


@query("sliding_rates", "SELECT w, kind, count(*) AS n FROM (SELECT kind, unnest(range(CAST(floor(t / 300) AS BIGINT) - 11, CAST(floor(t / 300) AS BIGINT) + 1)) * 300 AS w FROM ev) GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    r = ev(spark, sf_dir).groupBy(F.window("ts", "1 hour", "5 minutes"), "kind").agg(F.count("*").alias("n"))
    return r.select(F.unix_seconds("window.start").alias("w"), "kind", "n")


@query("session_windows", "WITH g AS (SELECT user_id, t, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NULL OR t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= 1800 THEN 1 ELSE 0 END AS fresh, event_id FROM ev), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(min(t), 3) AS start FROM s GROUP BY user_id, s", ("ev",))
def _(spark, sf_dir):
    s = ev(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"), F.min("t").alias("start"))
    return s.select("user_id", "n", F.round("start", 3).alias("start"))


@query(
    "lag_pairs",
    """SELECT a.kind AS cause, b.kind AS effect, count(*) AS n, round(avg(lag), 4) AS lag_mean FROM (SELECT a.event_id, a.kind, b.kind AS k2, min(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS lag FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.kind <> b.kind
    AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 500000 AND 3600000000 GROUP BY 1, 2, 3) a, (SELECT 1) x, LATERAL (SELECT a.k2 AS kind) b GROUP BY 1, 2""".replace(", (SELECT 1) x, LATERAL (SELECT a.k2 AS kind) b", "").replace("b.kind AS effect", "k2 AS effect").replace("SELECT a.kind AS cause", "SELECT a.kind AS cause"),
    ("ev",),
)
def _(spark, sf_dir):
    p = E.lag_pairs(ev(spark, sf_dir), 0.5, 3600.0)
    return p.groupBy("cause", "effect").agg(F.count("*").alias("n"), F.round(F.avg("lag"), 4).alias("lag_mean"))


@query("kind_sequences", "WITH g AS (SELECT kind, lag(kind) OVER w AS before, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT before, kind, count(*) AS n, round(avg(gap), 4) AS gap FROM g WHERE before <> kind AND gap <= 21600 GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    w = E.in_order("user_id")
    g = ev(spark, sf_dir).select("kind", F.lag("kind").over(w).alias("before"), (c("t") - F.lag("t").over(w)).alias("gap"))
    return g.where("before <> kind and gap <= 21600").groupBy("before", "kind").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("gap"))


def _motif_sql(n):
    leads = ", ".join(f"lead(kind, {k}) OVER w AS k{k}, lead(t, {k}) OVER w AS t{k}" for k in range(1, n))
    ts = ["t"] + [f"t{k}" for k in range(1, n)]
    fits = " AND ".join(f"{b} - {a} <= 43200" for a, b in zip(ts, ts[1:]))
    names = " || '>' || ".join(["kind"] + [f"k{k}" for k in range(1, n)])
    return f"WITH l AS (SELECT kind, t, {leads} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT {names} AS motif, count(*) AS n, round(avg(({ts[-1]} - t) / {n - 1}), 3) AS gap_mean, round(stddev_pop(({ts[-1]} - t) / {n - 1}) / avg(({ts[-1]} - t) / {n - 1}), 5) AS gap_cv FROM l WHERE {fits} GROUP BY 1"


def _motif(n):
    @query(f"motifs_{n}", _motif_sql(n), ("ev",))
    def _(spark, sf_dir):
        return E.motifs(ev(spark, sf_dir), n, 43200.0).select("motif", "n", F.round("gap_mean", 3).alias("gap_mean"), F.round("gap_cv", 5).alias("gap_cv"))


for _n in (2, 3, 4, 5):
    _motif(_n)


@query("event_chains", "WITH g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w, 1e18) > 7200 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS chain FROM g) SELECT user_id, CAST(chain AS BIGINT) AS chain, count(*) AS n, round(max(t) - min(t), 3) AS span FROM s GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return E.chains(ev(spark, sf_dir), 7200.0).select("user_id", "chain", "n", F.round(c("stop") - c("start"), 3).alias("span"))


_PER = " UNION ALL ".join(f"SELECT kind, count(*) AS n, '{k}' AS period, {p} AS seconds, sqrt(pow(sum(cos(t * (2 * pi() / {p}))), 2) + pow(sum(sin(t * (2 * pi() / {p}))), 2)) / count(*) AS strength, max(t) - min(t) AS span FROM ev GROUP BY kind" for k, p in E.PERIODS.items())


@query("periodicity", f"WITH p AS ({_PER}) SELECT kind, n, period, round(strength, 4) AS strength FROM p WHERE span >= 1.5 * seconds", ("ev",))
def _(spark, sf_dir):
    return E.periodicity(ev(spark, sf_dir), "kind").select("kind", "n", "period", F.round("strength", 4).alias("strength"))


@query(
    "burst_windows",
    """WITH r AS (SELECT user_id, CAST(floor((t - min(t) OVER (PARTITION BY user_id)) / 86400) AS BIGINT) AS bin FROM ev WHERE kind = 'click'), n AS (SELECT user_id, bin, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT user_id, unnest(range(max(bin) + 1)) AS bin FROM n GROUP BY user_id)
    SELECT user_id, bin, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (user_id, bin)""",
    ("ev",),
)
def _(spark, sf_dir):
    return E.bins(ev(spark, sf_dir).where("kind = 'click'"), 86400.0, "user_id")


@query(
    "burst_scores",
    """WITH r AS (SELECT user_id, CAST(floor((t - min(t) OVER (PARTITION BY user_id)) / 86400) AS BIGINT) AS bin FROM ev WHERE kind = 'click'), n AS (SELECT user_id, bin, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT user_id, unnest(range(max(bin) + 1)) AS bin FROM n GROUP BY user_id),
    x AS (SELECT user_id, list({'x': coalesce(n, 0)::DOUBLE, 'mean': 0.0::DOUBLE, 'var': 0.0::DOUBLE, 'n': 0, 'z': 0.0::DOUBLE} ORDER BY bin) AS xs FROM e LEFT JOIN n USING (user_id, bin) GROUP BY 1),
    s AS (SELECT user_id, list_reduce(xs, lambda s, e: {'x': e.x, 'mean': CASE WHEN s.n = 0 THEN e.x ELSE s.mean + 0.2 * (e.x - s.mean) END, 'var': CASE WHEN s.n = 0 THEN 0.0 ELSE 0.8 * (s.var + 0.2 * (e.x - s.mean) * (e.x - s.mean)) END, 'n': s.n + 1, 'z': CASE WHEN s.n < 3 OR sqrt(s.var) < 1e-10 THEN 0.0 ELSE (e.x - s.mean) / sqrt(s.var) END},
    {'x': 0.0::DOUBLE, 'mean': 0.0::DOUBLE, 'var': 0.0::DOUBLE, 'n': 0, 'z': 0.0::DOUBLE}) AS s FROM x) SELECT user_id, round(s.mean, 6) AS mean, round(s.z, 6) AS z, abs(s.z) > 2.5 AS anomaly FROM s""",
    ("ev",),
)
def _(spark, sf_dir):
    b = E.bins(ev(spark, sf_dir).where("kind = 'click'"), 86400.0, "user_id")
    rows = b.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("double")).alias("x"))
    return rows.select("user_id", E.ewma(c("x")).alias("s")).select("user_id", F.round("s.mean", 6).alias("mean"), F.round("s.z", 6).alias("z"), (F.abs("s.z") > 2.5).alias("anomaly"))


THEN_ = 1705752000.0  # 2024-01-20 12:00, within the events
HAWKES = """he AS (SELECT user_id, event_id, t FROM ev WHERE t < 1705752000.0), hg AS (SELECT user_id, event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM he),
    hq AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM hg WHERE gap > 0), hf AS (SELECT user_id, max(n) AS n, avg(gap) AS m, var_pop(gap) AS v, max(gap) FILTER (r = n // 2) AS med FROM hq GROUP BY user_id),
    hp AS (SELECT user_id, coalesce(n, 0) AS n, total, last, coalesce(1 / m, 1 / 3600.0::DOUBLE) AS mu, coalesce(greatest(0.05, least(0.85, (v / (m * m)) / (1 + v / (m * m)))), 0.3) AS br, coalesce(1 / med, 1 / 300.0::DOUBLE) AS beta FROM (SELECT user_id, count(*) AS total, max(t) AS last FROM he GROUP BY 1) LEFT JOIN hf USING (user_id)),
    hk AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM he), hx AS (SELECT user_id, sum(br * beta * exp(-beta * (1705752000.0 - t))) AS x FROM hk JOIN hp USING (user_id) WHERE r <= 500 AND t >= last - 4.6 / beta GROUP BY 1),
    hh AS (SELECT user_id, CAST(floor((t % 86400) / 3600) AS BIGINT) AS h, count(*) AS n FROM he GROUP BY 1, 2), hw AS (SELECT user_id, h, 24 * (coalesce(hh.n, 0) + 1) / (total + 24.0::DOUBLE) AS w FROM hp CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN hh USING (user_id, h)),
    ht AS (SELECT k, ((1705752000.0 + 60.0 * k) % 86400) / 3600.0 AS fh FROM (SELECT unnest(range(241)) AS k)),
    hl AS (SELECT p.user_id, k, mu / (1 - br) AS stationary, total, greatest(0, mu * (a.w + (fh - floor(fh)) * (b.w - a.w)) + x * exp(-beta * 60.0 * k)) AS rate FROM hp p JOIN hx USING (user_id) CROSS JOIN ht JOIN hw a ON a.user_id = p.user_id AND a.h = CAST(floor(fh) AS BIGINT) JOIN hw b ON b.user_id = p.user_id AND b.h = (CAST(floor(fh) AS BIGINT) + 1) % 24),
    hc AS (SELECT *, sum(rate * 60.0) OVER (PARTITION BY user_id ORDER BY k) AS cum FROM hl), hit AS (SELECT user_id, min(k) FILTER (cum >= 1) AS hit FROM hc GROUP BY 1),
    hn AS (SELECT user_id, any_value(hit) AS hit, any_value(total) AS total, any_value(stationary) AS stationary, max(rate) AS peak, min(k) FILTER (rate = top) AS top_k, max(rate) FILTER (k = 0) AS now_rate FROM (SELECT hc.*, hit, max(rate) OVER (PARTITION BY user_id) AS top FROM hc JOIN hit USING (user_id) WHERE k <= coalesce(hit, 240)) GROUP BY 1)"""


@query("hawkes_fit", f"WITH {HAWKES} SELECT user_id, n, total, round(mu, 9) AS mu, round(br, 6) AS branching, round(beta, 9) AS beta FROM hp", ("ev",))
def _(spark, sf_dir):
    fit = E.hawkes_fit(ev(spark, sf_dir).where(c("t") < THEN_), "user_id")
    return fit.select("user_id", "n", "total", F.round("mu", 9).alias("mu"), F.round("branching", 6).alias("branching"), F.round("beta", 9).alias("beta"))


@query("circadian_profile", "WITH h AS (SELECT kind, CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2), k AS (SELECT kind, sum(n) AS total, unnest(range(24)) AS hour FROM h GROUP BY kind) SELECT kind, hour, round(24 * (coalesce(n, 0) + 1) / (total + 24)::DOUBLE, 6) AS weight FROM k LEFT JOIN h USING (kind, hour)", ("ev",))
def _(spark, sf_dir):
    return E.circadian(ev(spark, sf_dir), "kind").select("kind", "hour", F.round("weight", 6).alias("weight"))


@query("hawkes_intensity", f"WITH {HAWKES} SELECT user_id, round(rate, 9) AS intensity, round(stationary, 9) AS stationary FROM hl WHERE k = 0", ("ev",))
def _(spark, sf_dir):
    model = E.point_process(ev(spark, sf_dir), THEN_, "user_id")
    return model.select("user_id", F.round(E.intensity(THEN_, F.lit(0.0)), 9).alias("intensity"), F.round("stationary", 9).alias("stationary"))


@query("intensity_curve", f"WITH {HAWKES} SELECT user_id, k // 30 AS step, round(rate, 9) AS intensity FROM hl WHERE k % 30 = 0", ("ev",))
def _(spark, sf_dir):
    model = E.point_process(ev(spark, sf_dir), THEN_, "user_id").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return model.select("user_id", "step", F.round(E.intensity(THEN_, 1800.0 * c("step")), 9).alias("intensity"))


_PREDICTED = "round(1705752000.0 + 60.0 * coalesce(hit, top_k), 3) AS expected, round(peak, 9) AS peak, round(CASE WHEN hit IS NOT NULL THEN least(1, peak / stationary) ELSE least(0.5, 0.3 * peak / stationary) END, 6) AS confidence"


@query("predict_next", f"WITH {HAWKES} SELECT user_id, {_PREDICTED} FROM hn WHERE total >= 3 AND peak > 0", ("ev",))
def _(spark, sf_dir):
    out = E.predict_next(E.point_process(ev(spark, sf_dir), THEN_, "user_id"), THEN_)
    return out.select("user_id", F.round("expected", 3).alias("expected"), F.round("peak", 9).alias("peak"), F.round("confidence", 6).alias("confidence"))


@query("anticipate_all", f"WITH {HAWKES} SELECT user_id, {_PREDICTED} FROM hn WHERE total >= 5 AND now_rate > 1.5 * stationary", ("ev",))
def _(spark, sf_dir):
    out = E.anticipate(ev(spark, sf_dir), THEN_, "user_id")
    return out.select("user_id", F.round("expected", 3).alias("expected"), F.round("peak", 9).alias("peak"), F.round("confidence", 6).alias("confidence"))


@query(
    "granger_lift",
    """WITH b AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS w, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS c, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS e FROM ev GROUP BY 1, 2), y AS (SELECT user_id, unnest(range(min(w), max(w) + 1)) AS w FROM b GROUP BY user_id),
    f AS (SELECT user_id, w, coalesce(c, 0) AS c, coalesce(e, 0) AS e FROM y LEFT JOIN b USING (user_id, w)), l AS (SELECT *, lead(e) OVER (PARTITION BY user_id ORDER BY w) AS after FROM f), s AS (SELECT user_id, count(*) AS n, avg(after) AS rate, avg(CASE WHEN c = after THEN 1.0 ELSE 0.0 END) AS acc FROM l WHERE after IS NOT NULL GROUP BY user_id HAVING count(*) >= 3)
    SELECT user_id, n, round(acc, 6) AS accuracy, round(acc - greatest(rate, 1 - rate), 6) + 0.0 AS lift FROM s""",
    ("ev",),
)
def _(spark, sf_dir):
    return E.granger(ev(spark, sf_dir), 86400.0, "view", "purchase").select("user_id", "n", F.round("accuracy", 6).alias("accuracy"), (F.round("lift", 6) + 0.0).alias("lift"))


@query(
    "derived_signals",
    """SELECT user_id, count(*) AS events, round(avg(CASE WHEN kind = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(avg(CASE WHEN kind = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS buy_rate, count(DISTINCT kind) AS kinds, round(count(*) / ((max(t) - min(t)) / 86400), 6) AS per_day,
    round(avg(CASE WHEN (t % 86400) < 21600 THEN 1.0 ELSE 0.0 END), 6) AS night_share, round(avg(k), 6) AS k_mean FROM ev GROUP BY user_id HAVING count(*) > 1""",
    ("ev",),
)
def _(spark, sf_dir):
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    g = ev(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("events"), share(c("kind") == "error").alias("error_rate"), share(c("kind") == "purchase").alias("buy_rate"), F.countDistinct("kind").alias("kinds"),
        F.round(F.count("*") / ((F.max("t") - F.min("t")) / 86400), 6).alias("per_day"), share(F.pmod(c("t"), F.lit(86400.0)) < 21600).alias("night_share"), F.round(F.avg("k"), 6).alias("k_mean"),
    )
    return g.where("events > 1")


@query("normalized_hours", "WITH h AS (SELECT CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1) SELECT hour, round(n / avg(n) OVER (), 6) AS weight FROM h", ("ev",))
def _(spark, sf_dir):
    h = ev(spark, sf_dir).groupBy(F.floor(F.pmod(c("t"), F.lit(86400.0)) / 3600).alias("hour")).agg(F.count("*").alias("n"))  # 24 rows
    return h.select("hour", F.round(c("n") / F.avg("n").over(Window.partitionBy(F.lit(1))), 6).alias("weight"))


@query("open_loops", "SELECT user_id, count(*) AS open_loops FROM (SELECT user_id, k, max(CASE WHEN kind = 'signup' THEN t END) AS a, max(CASE WHEN kind = 'purchase' THEN t END) AS b FROM ev GROUP BY 1, 2) WHERE a IS NOT NULL AND (b IS NULL OR b < a) GROUP BY user_id", ("ev",))
def _(spark, sf_dir):
    g = ev(spark, sf_dir).groupBy("user_id", "k").agg(F.max(F.when(c("kind") == "signup", c("t"))).alias("a"), F.max(F.when(c("kind") == "purchase", c("t"))).alias("b"))
    return g.where("a is not null and (b is null or b < a)").groupBy("user_id").agg(F.count("*").alias("open_loops"))
