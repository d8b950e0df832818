"""Queries for streams, sinks, gates, seals, studies, controls and word tables, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.functions import text as X
from trialworks.operators import controls as C
from trialworks.operators import effects as E
from trialworks.operators import lexicon as L
from trialworks.operators import models as M
from trialworks.operators import privacy as P
from trialworks.operators import splits as G
from trialworks.operators import study as Q
from trialworks.plans.diagnostics import RATED, VECTORS, surface
from trialworks.plans.fixtures import VIEWS, sql, view
from trialworks.plans.registry import _ORACLES, LABELLED, PAIRS, duck_hash01, labelled, labelled_arms, query, table
from trialworks.sources import readers as R
from trialworks.storage import shared_dir, written
from trialworks.streaming import batches as B
from trialworks.streaming import decisions as D
from trialworks.streaming import jobs as J


def stream(spark, d: str, name: str):
    """The table as a log that grows by files; a pattern as path, so that it may be one file as well as a folder of them."""
    rows = spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{{{name}}}.parquet")
    return rows.select(*[F.col(f.name).cast("timestamp") if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in rows.schema.fields])


def events(spark, d):
    return spark.sql(sql("event_stream", "spark").replace("from events", "from {events}"), events=stream(spark, d, "events"))


EVENTS = f"ev as ({sql('event_stream', 'duckdb')})"


@query(f"with {EVENTS} select test_id, arm, sum(impressions)::bigint as impressions, sum(clicks)::bigint as clicks from ev group by test_id, arm")
def stream_arm_counters(spark, d):
    return J.settled(J.arm_counters(events(spark, d)), "arm-counters", "complete")


@query(f"with {EVENTS} select date_trunc('day', ts)::timestamp as start, test_id, sum(impressions)::bigint as impressions, sum(clicks)::bigint as clicks, sum(clicks) / sum(impressions) as ctr from ev group by all")
def stream_windowed_rates(spark, d):
    return J.settled(J.windowed_rates(events(spark, d)), "windowed-rates", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_id, event_type from events")
def stream_first_sight(spark, d):
    log = stream(spark, d, "events").select("event_id", "event_type", "ts")
    return J.settled(J.first_sight(log.unionByName(log), "event_id"), "first-sight").select("event_id", "event_type")


@query("""with o as (select o_orderkey as id, o_orderdate as sealed_at, o_orderdate + to_days((o_orderkey % 40 - 3)::int) as resolved_at from orders)
select id, sealed_at, resolved_at from o where resolved_at > sealed_at and resolved_at <= sealed_at + interval 30 days""")
def stream_resolved(spark, d):
    o = stream(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("sealed_at"))
    r = o.select(F.col("o_orderkey").alias("prediction_id"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 40 - 3 as int))").alias("resolved_at"))
    out = J.settled(J.resolved(p, r).select("id", "sealed_at", "resolved_at"), "resolved")
    return out.select("id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("sealed_at", "resolved_at")])


@query("""with o as (select o_custkey as id, cast(o_orderkey % 2 as int) as actual, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey % 2) as k from orders)
select id, actual, k = 1 as accepted, count(*) as n from o group by all""")
def stream_write_once(spark, d):
    o = stream(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).cast("int").alias("actual"), F.col("o_orderdate").alias("resolved_at"))
    path = f"{shared_dir(spark)}/write-once-{uuid.uuid4().hex}"
    D.first_outcomes(o, path).awaitTermination()
    return B.committed(spark, path, "outcomes", D.ONCE).groupBy("id", "actual", "accepted").agg(F.count("*").alias("n"))


def tenants(spark, d):
    return spark.sql(sql("tenant_rows", "spark").replace("from customer", "from {customer}"), customer=stream(spark, d, "customer"))


@query(_ORACLES["audit_chain"])
def stream_audit_chain(spark, d):
    return J.settled(J.chained(tenants(spark, d)), "audit-chain")


@query(_ORACLES["track_record"])
def stream_track_record(spark, d):
    p = spark.sql(sql("predictions", "spark").replace("from orders", "from {orders}"), orders=stream(spark, d, "orders"))
    return J.settled(J.running_record(p), "track-record", "complete")


RETAINED = "select o_orderkey as id from orders where date_diff('second', o_orderdate, timestamp '1998-08-02 00:00:00') / 86400.0 <= 365"
NOW = "1998-08-02 00:00:00"


@query(RETAINED)
def stream_retention_sweep(spark, d):
    return J.settled(J.retention_sweep(stream(spark, d, "orders"), 365, F.lit(NOW).cast("timestamp"), "o_orderdate").select(F.col("o_orderkey").alias("id")), "retention")


@query(RETAINED)
def apply_retention(spark, d):
    return P.apply_retention(table(spark, d, "orders"), 365, F.lit(NOW).cast("timestamp"), "o_orderdate").select(F.col("o_orderkey").alias("id"))


@query(_ORACLES["labelled_arms"])
def labelled_arms_sink(spark, d):
    return R.write_labelled_arms(labelled_arms(spark, d), f"{shared_dir(spark)}/labelled-arms-{uuid.uuid4().hex}")


@query("select o_orderkey, o_custkey from orders")
def incremental_ingest(spark, d):
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_custkey"), f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    R.incremental_ingest(rows.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    R.incremental_ingest(rows, path, "o_orderkey")  # resumes: only what is missing
    return R.ingested(spark, path)


@query("select doc_id, length(text) as chars from documents where length(trim(text, ' ')) > 0")
def parquet_text(spark, d):
    return R.read_parquet_text(spark, f"{d}/documents.parquet", ["doc_id", "text"]).select("doc_id", F.length("text").cast("long").alias("chars"))


@query(f"""with c as ({sql('campaigns', 'duckdb')})
select id, case when impressions < 500 then 'too few impressions' when clicks > impressions then 'clicks out of range' end as finding from c where impressions < 500 or clicks > impressions
union all select id, 'copy: email' from c where id % 50 = 0""")
def pii_preview(spark, d):
    c = view(spark, d, "campaigns").withColumn("copy", F.expr("if(id % 50 = 0, concat(copy, ' write to me@example.com'), copy)"))
    problems, issues = P.pii_preview(c, "id", Q.campaign_reason())
    issues = issues.select("row", F.concat_ws(": ", "column", F.array_join("kinds", ", ")).alias("problem"))
    return problems.unionByName(issues).toDF("id", "finding")


@query("select 'tenant-7' as tenant_id, c_custkey as seq from customer where c_nationkey = 7")
def tenant_scope(spark, d):
    rows = view(spark, d, "tenant_rows").withColumn("tenant_id", F.concat(F.lit("tenant-"), "tenant_id"))
    return P.tenant_scope(rows, "tenant-7").select("tenant_id", "seq")


@query("select c_custkey as seq, 'tenant-7' as tenant_id from customer")
def tenant_stamp(spark, d):
    return P.tenant_stamp(view(spark, d, "tenant_rows"), "tenant-7").select("seq", "tenant_id")


def predictions(spark, d):
    p = view(spark, d, "predictions").withColumnRenamed("predicted", "predicted_winner")
    return p.withColumns({"variants": F.array(F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), F.col("id"))), "tier": S.confidence_tier(F.col("margin"))})


@query("select o_orderkey % 7 <> 0 as intact, count(*) as n from orders group by all")
def verify_seal(spark, d):
    """Outcomes come later and change nothing; every seventh prediction's margin is edited after the seal."""
    sealed = Q.seal(predictions(spark, d)).withColumn("actual", F.col("user_pick"))
    edited = sealed.withColumn("margin", F.expr("if(id % 7 = 0, margin + 1, margin)"))
    return Q.verify_seal(edited).groupBy("intact").agg(F.count("*").alias("n"))


@query(f"""with p as ({sql('predictions', 'duckdb')}) select strftime(created_at, '%Y-%m-%d') as date, 2 as variant_count, case when margin >= 0.948 then 'high' when margin >= 0.519 then 'moderate' else 'insufficient' end as tier,
round(margin, 4) as margin, predicted = actual as model_correct, user_pick = actual as user_correct from p where actual is not null""")
def export_allow_list(spark, d):
    out = Q.export_allow_list(Q.seal(predictions(spark, d)).withColumnRenamed("predicted_winner", "predicted"))
    return out.drop("hash")  # its content is verify_seal's


POWER = "(1.96 * 0.5 + 0.84 * sqrt({r} * (1 - {r}))) / ({r} - 0.5)"


@query(f"""with s as (select d.source, avg((l.quality = d.doc_id % 2)::int) as h, avg((l.toxic = 0)::int) as m from labels l join documents d on l.doc_id = d.doc_id where l.quality is not null and d.source is not null group by d.source),
q as (select *, h * (1 - m) + m * (1 - h) as dis from s), r as (select *, m * (1 - h) / nullif(dis, 0) as q from q)
select source, case when dis > 0 and abs(q - 0.5) >= 1e-9 then ceil(pow(1.96 * 0.5 + 0.84 * sqrt(q * (1 - q)), 2) / pow(q - 0.5, 2) / dis) else 0 end::bigint as items, case when m > 0.5 then ceil(pow({POWER.format(r='m')}, 2)) end::bigint as outcomes from r""")
def study_power(spark, d):
    rows = table(spark, d, "labels").where("quality is not null").join(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id")
    s = rows.groupBy("source").agg(F.avg((F.col("quality") == F.col("doc_id") % 2).cast("int")).alias("h"), F.avg((F.col("toxic") == 0).cast("int")).alias("m"))
    return s.select("source", S.items_needed(F.col("h"), F.col("m")).alias("items"), S.outcomes_needed(F.col("m")).alias("outcomes"))


QUIZ = "test_id || '|' || hi_id || '|' || lo_id"


@query(f"""with {PAIRS}, t as (select test_id, hi_id, lo_id, md5(({QUIZ}) || ':8') as h8 from pairs order by md5(({QUIZ}) || ':7') limit 40)
select test_id, hi_id, lo_id, case when row_number() over (order by h8) <= 20 then 0 else 1 end as winner_position from t""")
def balanced_quiz(spark, d):
    return Q.balanced_quiz(E.build_pairs(labelled(spark, d)), 40).select("test_id", "hi_id", "lo_id", "winner_position")


ERF_SQL = "sign({x}) * (1 - ((((({a[4]} * t + {a[3]}) * t) + {a[2]}) * t + {a[1]}) * t + {a[0]}) * t * exp(-({x}) * ({x})))"


@query(f"""with {LABELLED}, e as (select test_id, arm_id, target as x, 1 / (1 + {S.ERF_P} * abs(target)) as t, 1 / (1 + {S.ERF_P} * abs(target / sqrt(2))) as u from lab)
select test_id, arm_id, 1 / (1 + exp(-x)) as sigmoid, ln(1 + exp(x)) as softplus, {ERF_SQL.format(x='x', a=S.ERF_A)} as erf, x * 0.5 * (1 + {ERF_SQL.format(x='x / sqrt(2)', a=S.ERF_A).replace('* t', '* u')}) as gelu from e""")
def activations(spark, d):
    x = F.col("target")
    return labelled(spark, d).select("test_id", "arm_id", S.sigmoid(x).alias("sigmoid"), S.softplus(x).alias("softplus"), S.erf(x).alias("erf"), S.gelu(x).alias("gelu"))


@query("""with e as (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i from embeddings), s as (select *, avg(x) over w as m, var_pop(x) over w as v from e window w as (partition by vec_id))
select vec_id, round((x - m) / sqrt(v + 1e-5), 6) as first from s where i = 0""")
def layer_norm(spark, d):
    v = S.layer_norm(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(v, 1), 6).alias("first"))


# Word tables of the test data: frequencies and emotion lists by hash, over the lexicon's vocabulary and beyond it.
VIEWS["word_freq"] = "select word, case when {hash:word:31} < 0.1 then 0.0 else round(7 * {hash:word:30}, 3) end as zipf from (select distinct word from ({words})) where {hash:word:32} < 0.8"
VIEWS["word_emotion"] = "select word, " + ", ".join(f"{{hash:word:{70 + i}}} < 0.15 as {e}" for i, e in enumerate([*L.EMOTIONS, *L.SENTIMENTS])) + " from (select distinct word from ({words}))"


@query(f"""with lex as (select word, zipf from ({sql('word_freq', 'duckdb')}) where zipf > 0), {RATED[RATED.index('ct as'):]}
select doc_id, coalesce(avg(zipf), 0)::double as zipf_mean, coalesce(min(zipf), 0)::double as zipf_min, coalesce(stddev_pop(zipf), 0)::double as zipf_sd,
coalesce(count(*) filter (zipf < 3) / nullif(count(zipf), 0), 0)::double as rare_word_frac, coalesce(count(*) filter (zipf > 5) / nullif(count(zipf), 0), 0)::double as common_word_frac from rt group by doc_id""")
def frequency_features(spark, d):
    return L.frequency_features(table(spark, d, "documents"), view(spark, d, "word_freq"))


ALL = [*L.EMOTIONS, *L.SENTIMENTS]


@query(f"""with lex as (select * from ({sql('word_emotion', 'duckdb')})), {RATED[RATED.index('ct as'):]},
g as (select doc_id, greatest(max(looked_up), 1) as n, {', '.join(f'count(*) filter ({e}) as {e}' for e in ALL)} from rt group by doc_id)
select doc_id, {', '.join(f'{e} / n as emo_{e}' for e in ALL)}, ({' + '.join(f'({e} > 0)::int' for e in L.EMOTIONS)}) / 8 as emo_diversity, greatest({', '.join(L.EMOTIONS)}) / n as emo_intensity, (negative - positive) / n as emo_neg_minus_pos from g""")
def emotion_features(spark, d):
    tags = F.array_compact(F.array(*[F.when(F.col(e), F.lit(e)) for e in ALL]))
    return L.emotion_features(table(spark, d, "documents"), view(spark, d, "word_emotion").select("word", tags.alias("tags")))


# Controls: ridge fits of the target on two features, validated on every fifth experiment.
ROWS = f"{LABELLED}, r as (select test_id, arm_id, test_id || '/' || arm_id as key, ctr, length(copy_text)::double / 50 as chars, target as y, test_id % 5 <> 0 as fit from lab)"
FITS = """s as (select variant, sum(ctr * ctr) + 1 as aa, sum(ctr * chars) as ab, sum(chars * chars) + 1 as bb, sum(ctr * y) as ay, sum(chars * y) as cy from v where fit group by variant),
w as (select variant, (ay * bb - cy * ab) / (aa * bb - ab * ab) as w1, (aa * cy - ab * ay) / (aa * bb - ab * ab) as w2 from s),
f as (select variant, fit, avg((y - ctr * w1 - chars * w2) ** 2) as e, var_pop(y) as vp from v join w using (variant) group by variant, fit),
o as (select variant, round(max(1 - e / vp) filter (fit), 6) as train_r2, round(max(1 - e / vp) filter (not fit), 6) as val_r2 from f group by variant)"""


def keyed():
    return F.concat_ws("/", F.col("test_id").cast("string"), "arm_id")


def fit_rows(spark, d):
    return labelled(spark, d).select("test_id", "arm_id", "ctr", (F.length("copy_text") / F.lit(50.0)).alias("chars"), F.col("target").alias("y"), (F.col("test_id") % 5 != 0).alias("fit"))


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("train_r2", "val_r2")})


@query(f"""with {ROWS}, t as (select * from r where fit), {', '.join(f"p{k} as (select a.test_id, a.arm_id, a.ctr, a.chars, b.y, true as fit from (select *, row_number() over (partition by test_id order by key) as spot from t) a join (select test_id, y, row_number() over (partition by test_id order by {duck_hash01('key', 40 + k)}, key) as spot from t) b using (test_id, spot))" for k in range(3))},
v as (select 'real' as variant, ctr, chars, y, fit from r{''.join(f" union all select 'shuffled {k + 1}', ctr, chars, y, fit from p{k} union all select 'shuffled {k + 1}', ctr, chars, y, fit from r where not fit" for k in range(3))}), {FITS}
select *, case when variant = 'real' then val_r2 > (select max(val_r2) from o where variant <> 'real') end as passed from o""")
def label_permutation_control(spark, d):
    return rounded(C.label_permutation_control(fit_rows(spark, d), ["ctr", "chars"], "y", "test_id", keyed()))


@query(f"""with {ROWS}, v as (select 'ridge' as variant, * from r), {FITS}, m as (select avg(y) as m from r where fit), n as (select fit, 1 - avg((y - m) ** 2) / var_pop(y) as r2 from r, m group by fit)
select * from o union all select 'mean', round(max(r2) filter (fit), 6), round(max(r2) filter (not fit), 6) from n""")
def baseline_floor(spark, d):
    return rounded(C.baseline_floor(fit_rows(spark, d), ["ctr", "chars"], "y"))


@query(f"""with {ROWS}, v as (select c::varchar as variant, r.* from r, (values (0.25), (0.5), (1.0)) x(c) where not fit or {duck_hash01('key', 50)} < c), {FITS.replace('select variant, round', "select case variant when '0.25' then '0.25' when '1.00' then '1.0' when '0.50' then '0.5' else variant end as variant, round")}
select *, train_r2 - val_r2 < 0.25 as sound from o""")
def learning_curve(spark, d):
    return rounded(C.learning_curve(fit_rows(spark, d), ["ctr", "chars"], "y", keyed()))


def drawn_sql(seed: int) -> str:
    key = "test_id || '/' || arm_id || '/' || rep"
    u = f"sqrt(-2 * ln(greatest({duck_hash01(key, seed)}, 1e-12))) * cos(2 * pi() * {duck_hash01(key, seed + 1)})"
    return f"floor(least(impressions::double, greatest(0, impressions * p + sqrt(impressions * p * (1 - p)) * {u})) + 0.5)"


GAPS = [0.05, 0.2, 0.5]


@query(f"""with {LABELLED}, dr as (select test_id, arm_id, rep, impressions as n, {drawn_sql(60)} as c1, {drawn_sql(62)} as c2 from (select *, clicks / impressions as p from lab), (select unnest(range(1, 5)) as rep)),
l as (select test_id, arm_id, rep, ln((c1 + .5) / (n - c1 + .5)) as one, ln((c2 + .5) / (n - c2 + .5)) as two from dr),
pr as (select a.rep, a.one - b.one as one, a.two - b.two as two from l a join l b on a.test_id = b.test_id and a.rep = b.rep and a.arm_id < b.arm_id where a.one <> b.one),
g as (select gap, rep, avg(((one > 0) = (two > 0))::int) as agree, count(*) as n from pr, (select unnest({GAPS}) as gap) where abs(two) >= gap group by gap, rep)
select gap::double as gap, avg(agree) as ceiling, max(n) filter (rep = 4) as pairs from g group by gap""")
def replication_ceiling(spark, d):
    return C.replication_ceiling(labelled(spark, d), GAPS)


# Rankers, clusters, vectors and comparisons.
@query("select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\"'']')) as quotes from documents")
def quote_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.quote_count(F.coalesce("text", F.lit(""))).cast("long").alias("quotes"))


WHY = "the one final evaluation of the ranker"


@query(f"with {LABELLED} select '{WHY}' as reason, 'final' as evaluation, count(*) as n from lab where test_id % 5 = 0")
def read_log(spark, d):
    path = f"{shared_dir(spark)}/lock-{uuid.uuid4().hex}"
    G.unlock_test(labelled(spark, d).where("test_id % 5 = 0"), path, WHY, "final")
    return G.read_log(spark, path).select("reason", "evaluation", "n")


WORDED = ["n_words", "n_chars", "avg_word_len", "long_word_frac", "type_token_ratio"]


def worded(spark, d):
    """The labelled arms with their features, written once, since several passes read them."""
    arms = written(labelled(spark, d).select("test_id", "arm_id", "copy_text", "target", "weight"), "arms")
    return written(arms.join(surface(arms.select("arm_id", "copy_text").distinct(), "arm_id", "copy_text"), "arm_id"), "worded")


@query()
def fit_pairwise_ranker(spark, d):
    """Accuracy on every fifth experiment of a ranker fitted on the others."""
    diff = M.arm_differences(worded(spark, d), WORDED)
    w = M.fit_pairwise_ranker(diff.where("test_id % 5 <> 0"), WORDED)
    held = diff.where("test_id % 5 = 0")
    return held.agg(F.count("*").alias("n_pairs"), F.avg((M.linear_score(WORDED, w) > 0).cast("double")).alias("accuracy"))


@query()
def bagged_ensemble(spark, d):
    f = worded(spark, d)
    return M.bagged_ensemble(M.arm_differences(f, WORDED), f, WORDED).select("test_id", "arm_id", F.round("score", 4).alias("score"))


@query()
def topic_clusters(spark, d):
    return M.topic_clusters(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"""{VECTORS.format(vector="embedding").split("s as (select vec_id")[0]} u as (select label, i, x / case when n > 0 then n else 1 end as x from m join c using (label)), t as (select i, sum(x) as t from u group by i),
g as (select label, 1 - sum(x * (t - x)) / case when sum((t - x) ** 2) > 0 then sqrt(sum((t - x) ** 2)) else 1 end as distinctiveness from u join t using (i) group by label), z as (select label, count(*) as size from embeddings group by label)
select label, size, distinctiveness, size >= 5 and row_number() over (order by size >= 5 desc, round(distinctiveness, 9) desc, label) = 1 as chosen from g join z using (label)""")
def distinctive_clusters(spark, d):
    return M.distinctive_clusters(table(spark, d, "embeddings"), "label", "embedding", 5)


@query(f"""with tk as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]*')) as word from documents), tf as (select doc_id, floor({duck_hash01('word', 80)} * 4096)::bigint as place, count(*) as n from tk group by all),
i as (select place, ln(((select count(distinct doc_id) from documents) + 1) / (count(*) + 1)) as idf from tf group by place), w as (select doc_id, place, n * idf as w from tf join i using (place) where n * idf > 0)
select doc_id, place, w / sqrt(sum(w * w) over (partition by doc_id)) as x from w""")
def text_vectors(spark, d):
    return M.text_vectors(table(spark, d, "documents"))


GUARDED = _ORACLES["guard_ranking"]


@query(f"""{GUARDED[:GUARDED.rindex('select test_id, max(severity)')]}, ct as ({GUARDED[GUARDED.rindex('select test_id, max(severity)'):]}),
tk as (select test_id, rank, len(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) as n_words from t)
select l.test_id, l.arm_id, l.rank, l.margin, tk.n_words::double as n_words, s.severity::double as max_severity, ct.caution from (select test_id, arm_id, row_number() over w as rank, target - lead(target) over w as margin from lab window w as (partition by test_id order by target desc, arm_id)) l
join tk using (test_id, rank) join s using (test_id, rank) join ct using (test_id)""")
def compare_batch(spark, d):
    rows = labelled(spark, d).withColumn("text", F.expr("concat(copy_text, repeat('!', cast(length(copy_text) % 5 as int)))"))
    return M.compare_batch(rows, "target", "text").select("test_id", "arm_id", "rank", "margin", F.col("profile.n_words").alias("n_words"), "max_severity", "caution")
