"""Queries of deciding streams, vendors' files, audiences, tenants and whole studies, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialworks.operators import audience as A
from trialworks.operators import effects as E
from trialworks.operators import privacy as P
from trialworks.operators import study as Q
from trialworks.operators import tenants as T
from trialworks.plans.fixtures import sql, view
from trialworks.plans.operations import EVENTS, events, stream
from trialworks.plans.registry import PAIRS, RE2, duck_hash01, labelled, query, table, wilson_sql
from trialworks.sources import readers as R
from trialworks.storage import shared_dir
from trialworks.streaming import batches as B
from trialworks.streaming import decisions as D
from trialworks.streaming import jobs as J


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Streams.
@query(f"""with {EVENTS}, w as (select unnest(range(0, 4)) as k), s as (select time_bucket(interval 6 hours, ts::timestamp) - to_hours(6 * k::int) as start, test_id, arm, sum(impressions) as n, sum(clicks) as c from ev, w group by all),
t as (select *, sum(n) over g as ti, sum(c) over g as tc, count(*) over g as arms from s window g as (partition by start, test_id))
select start::timestamp as start, test_id, arm, n::bigint as impressions, c::bigint as clicks, round(ln((c + .5) / (n - c + .5)) - ln((tc + .5) / (ti - tc + .5)), 9) as target from t
where arms > 1 and ti > 0 and tc > 0 and start + interval 1 day <= (select max(ts)::timestamp from ev) - interval 1 hour""")
def stream_windowed_contrast(spark, d):
    out = J.settled(D.windowed_contrast(events(spark, d), slide="6 hours"), "contrast")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "test_id", F.col("arm").cast("long").alias("arm"), "impressions", "clicks", F.round("target", 9).alias("target"))


KEY = "test_id || '/' || arm || '/' || draw"


@query(f"""with {EVENTS}, c as (select test_id, arm, sum(impressions) as n, sum(clicks) as c from ev group by all), b as (select test_id, arm, 0.5 + c as al, 39.5 + n - c as be from c),
v as (select test_id, arm, draw, round(least(1, greatest(0, al / (al + be) + sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) * sqrt(-2 * ln(greatest({duck_hash01(KEY, 21)}, 1e-12))) * cos(2 * pi() * {duck_hash01(KEY, 22)}))), 12) as value
  from b, (select unnest(range(1, 201)) as draw)),
wn as (select test_id, draw, (list(arm order by value desc, arm desc))[1] as arm from v group by test_id, draw), k as (select test_id, arm, count(*) as k from wn group by all),
sh as (select b.test_id, b.arm, coalesce(k, 0) / 200 as share from b left join k using (test_id, arm)), best as (select test_id, max(share) as top, (list(arm order by share desc, arm desc))[1] as arm from sh group by test_id)
select sh.test_id, sh.arm::bigint as arm, share, case when top >= 0.4 then best.arm end::bigint as winner, case when top >= 0.4 then 0 end::bigint as since from sh join best using (test_id)""")
def stream_decisions(spark, d):
    path = folder(spark, "decisions")
    D.decide(J.arm_counters(events(spark, d)), path, confidence=0.4, draws=200).awaitTermination()
    return D.allocation(spark, path).join(D.decided(spark, path), "test_id")


@query("""with o as (select o_custkey as id, (o_orderkey % 2)::int as actual, o_orderdate::timestamp as tm, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey % 2) as k from orders),
r as (select id, actual, case when k = 1 then 'accepted' else 'rejected' end as kind from o union all select id, actual, 'swept' from o where k = 1 and tm + interval 30 days <= (select max(tm) from o) - interval 1 day)
select id, actual, kind, count(*) as n from r group by all""")
def stream_expiring_outcomes(spark, d):
    o = stream(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).alias("actual"), F.col("o_orderdate").cast("timestamp").alias("resolved_at"))
    path = folder(spark, "expiring")
    D.kept_outcomes(o, path).awaitTermination()
    return B.committed(spark, path, "outcomes", D.KINDS).groupBy("id", "actual", "kind").agg(F.count("*").alias("n"))


@query("select o_orderkey % 50 = 0 as held, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by all")
def stream_quarantine(spark, d):
    path = folder(spark, "quarantine")
    o = stream(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.concat("o_orderpriority", F.lit(" write to me@example.com"))).otherwise(F.col("o_orderpriority")).alias("copy"))
    D.quarantine_stream(o, "copy", path).awaitTermination()
    both = [B.committed(spark, path, name, "o_orderkey long").select("o_orderkey", F.lit(name == "held").alias("held")) for name in ("clean", "held")]
    return both[0].unionByName(both[1]).groupBy("held").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("select event_id, event_type from events")
def stream_ingest(spark, d):
    path, log = folder(spark, "stream-ingest"), stream(spark, d, "events").select("event_id", "event_type")
    D.ingest_stream(log.unionByName(log), path, "event_id").awaitTermination()
    return B.committed(spark, path, "rows", log.schema.toDDL()).drop("epoch")


# Files of vendors and quizzes, written from the tables and read back.
@query(f"""with c as ({sql('campaigns', 'duckdb')}) select copy, impressions::varchar as impressions, clicks::varchar as clicks, segment, campaign::varchar as "campaignId", count(*) as n from c group by all""")
def campaign_export(spark, d):
    path = folder(spark, "export")
    names = {"copy": "Body", "impressions": "Impr.", "clicks": "Website link clicks", "segment": "Age range", "campaign": "Ad name"}
    rows = view(spark, d, "campaigns").select(F.col("id").alias("Amount spent (GBP)"), *[F.col(c).alias(h) for c, h in names.items()], F.col("copy").alias("Headline 1"))
    rows.write.option("header", True).csv(path)
    rows, missing = R.read_campaign_export(spark, path)
    if missing:
        raise ValueError(f"missing: {missing}")
    return rows.groupBy(*R.CAMPAIGN_COLUMNS).agg(F.count("*").alias("n"))


@query("select event_id, user_id, event_type from events")
def jsonl_events(spark, d):
    path = folder(spark, "events")
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    lines.withColumn("value", F.expr("if(hash(value) % 7 = 0, concat('\\n', value, '\\n\\n'), value)")).write.text(path)
    return R.read_jsonl(spark, path, "event_id long, user_id long, event_type string")


TURNS = "conv_id long, turns array<struct<turn: long, role: string, text: string>>"


@query("select conv_id, turn, role, text, case when conv_id % 11 = 0 then 1 else 0 end::int as corrupt from conversations where conv_id % 11 <> 0 union all select conv_id, null, null, null, 1 from (select distinct conv_id from conversations where conv_id % 11 = 0)")
def nested_conversations(spark, d):
    """Conversations as one JSON line each, every eleventh cut off: the turns that can be read, and what cannot, by its id."""
    path = folder(spark, "conversations")
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    line = F.to_json(F.struct("conv_id", "turns"))
    nested.select(F.when(F.col("conv_id") % 11 == 0, F.concat(F.substring(line, 1, 25), F.lit("\n\n"))).otherwise(line).alias("value")).write.text(path)
    rows, bad, _ = R.read_nested(spark, path, TURNS)
    flat = rows.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.text", F.lit(0).alias("corrupt"))
    held = bad.select(F.regexp_extract("line", r'"conv_id":(\d+)', 1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("corrupt"))
    return flat.unionByName(held)


PAID = "ascii(right(participant, 1)) % 2 = 0"
STUDY = f"st as (select *, {PAID} as paid from ({sql('study', 'duckdb')}) where participant is not null)"


def answers(spark, d):
    return view(spark, d, "study").where("participant is not null").withColumn("paid", F.expr(PAID))


@query(f"with {STUDY} select participant, paid, item::varchar as item, choice::int as choice, ms::bigint as ms from st")
def quiz_responses(spark, d):
    """Answers as one folder of JSON a participant, nested, and read back. A file is read as one response, so what several
    tasks hold of a participant goes to a folder each."""
    path = folder(spark, "responses")
    a = F.collect_list(F.struct(F.col("item").cast("string").alias("id"), F.col("choice").cast("int").alias("choice"), F.col("ms").cast("long").alias("ms")))
    per = answers(spark, d).groupBy("participant", F.spark_partition_id().alias("part"), "paid").agg(a.alias("answers"))
    per.select("participant", F.lit(7).alias("seed"), F.struct(F.lit(None).cast("int").alias("years"), "paid").alias("profile"), "answers", "part").write.partitionBy("participant", "part").json(path)
    return R.read_responses(spark, path, 7, r"participant=([^/]+)/").select("participant", "paid", "item", "choice", "ms")


@query("select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then p_name end), ''), nullif(trim(case when p_partkey % 3 = 1 then p_type else ' ' end), ''), case when (length(p_brand), p_brand) > (length(p_type), p_type) then p_brand else p_type end) as text from part")
def pick_text(spark, d):
    p = table(spark, d, "part").withColumns({"a": F.expr("if(p_partkey % 3 = 0, p_name, null)"), "b": F.expr("if(p_partkey % 3 = 1, p_type, ' ')")})
    return p.select("p_partkey", R.pick_text(["a", "b"], ["p_brand", "p_type"]).alias("text"))


@query("select c_custkey, 'c_name=' || c_name || case when c_custkey % 2 = 0 then ',c_nationkey=' || c_nationkey else '' end as meta from customer")
def collect_meta(spark, d):
    c = table(spark, d, "customer").withColumn("c_nationkey", F.expr("if(c_custkey % 2 = 0, c_nationkey, null)"))
    entries = F.transform(F.array_sort(F.map_entries(R.collect_meta(["c_name", "c_nationkey"]))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.select("c_custkey", F.array_join(entries, ",").alias("meta"))


# Audiences.
AUDIENCE = {"involvement": ("high", "low", "unknown"), "age": ("younger", "older", "all"), "gender": ("male", "female", "all"), "education": ("lower", "higher", "all")}


def spec(axis: str, i: int, engine: str) -> str:
    """A case expression that deals customers over the full cross product of the axes."""
    div = "//" if engine == "duckdb" else "div"
    return f"case (c_custkey {div} {3**i}) % 3 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(AUDIENCE[axis])) + " end"


def audiences(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[F.expr(spec(a, i, "spark")).alias(a) for i, a in enumerate(AUDIENCE)])


SPEC = "a as (select c_custkey as id, " + ", ".join(f"{spec(a, i, 'duckdb')} as {a}" for i, a in enumerate(AUDIENCE)) + " from customer)"


def offset_sql(k: int) -> str:
    return " + ".join(f"case {axis} when '{plus}' then {half[k]} when '{minus}' then {-half[k]} else 0 end" for (axis, plus, minus), half in A.HALVES.items())


@query(f"""with {SPEC}, o as (select id, {', '.join(f'{offset_sql(k)} as {c}' for k, c in enumerate(('valence', 'arousal', 'dominance')))} from a)
select id, round(valence, 9)::double as valence, round(arousal, 9)::double as arousal, round(dominance, 9)::double as dominance, round(abs(valence) / {A.VALENCE_SD}, 9)::double as valence_sd, round(abs(arousal) / {A.AROUSAL_SD}, 9)::double as arousal_sd,
greatest(abs(valence) / {A.VALENCE_SD}, abs(arousal) / {A.AROUSAL_SD}) >= {A.PERCEPTIBLE} as perceptible from o""")
def audience_offset(spark, d):
    out = A.audience_offset(audiences(spark, d), "id", A.offset_priors(spark))
    return out.withColumns({c: F.round(c, 9) for c in ("valence", "arousal", "dominance", "valence_sd", "arousal_sd")})


def gain_sql(m: str) -> str:
    each = " * ".join(f"case when {axis} = '{value}' then {g[m]} else 1 end" for (axis, value, _), g in A.GAINS.items() if m in g) or "1"
    return f"least(1.15, greatest(0.85, {each}))::double as {m}"


HITS = {"applied": " + ".join(f"({a} = '{v}')::int" for a, v, _ in A.GAINS), "unsure": " + ".join(f"({a} = '{v}')::int" for a, v, c in A.GAINS if c == "low")}
DEVIATION = f"greatest({', '.join(f'abs({m} - 1)' for m in A.MODULES)})"


@query(f"""with {SPEC}, g as (select id, {', '.join(map(gain_sql, A.MODULES))}, {', '.join(f'{v} as {k}' for k, v in HITS.items())} from a)
select id, {', '.join(f'round({m}, 9) as {m}' for m in A.MODULES)}, applied::bigint as applied, unsure::bigint as unsure, round({DEVIATION}, 9) as max_deviation, {DEVIATION} = 0 as neutral from g""")
def segment_gains(spark, d):
    out = A.segment_gains(audiences(spark, d), "id", A.gain_priors(spark))
    return out.withColumns({c: F.round(c, 9) for c in (*A.MODULES, "max_deviation")})


SCORE = {"gate_w": 1.3, "gate_b": -0.4, "arousal_to_encoding": 0.6, "arousal_quad": -0.9, "arousal_lin": 0.7, "fluency": 0.5, "load": -0.2, "free_salience": 0.3, "free_valuation": 0.8, "free_encoding": 0.4, "bias": 0.1}


@query(f"""with {SPEC}, g as (select id, {', '.join(map(gain_sql, A.MODULES))} from a), x as (select id, {', '.join(f"{m} * {duck_hash01('id', 200 + i)} as {m}" for i, m in enumerate(A.MODULES))} from g)
select id, round(-0.9 * affect * affect + 0.7 * affect + 0.5 * control - 0.2 * (1 - control) + 0.3 * salience + 0.8 * valuation / (1 + exp(-(1.3 * salience - 0.4))) + 0.4 * encoding * (1 + 0.6 * affect) + 0.1, 9) as score from x""")
def module_score(spark, d):
    """Made-up activations of every customer's audience, with its gains applied."""
    from trialworks.functions import stats as S

    a = audiences(spark, d)
    acts = a.select("id", *[S.hash01(F.col("id").cast("string"), 200 + i).alias(m) for i, m in enumerate(A.MODULES)])
    gained = A.apply_gains(acts, A.segment_gains(a, "id", A.gain_priors(spark)), "id")
    return gained.select("id", F.round(A.module_score(SCORE), 9).alias("score"))


# Personal data: where it is, and how much of it a report shows.
PLACE_SQL = """select doc_id, '{k}' as kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as start, length(m[i])::int as len
from (select doc_id, string_split_regex(coalesce(text, ''), '{p}') as g, regexp_extract_all(coalesce(text, ''), '{p}') as m from documents), range(1, 100000) r(i) where i <= len(m)"""


@query(" union all ".join(PLACE_SQL.format(k=k, p=p) for k, p in RE2.items()))
def pii_places(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(P.locate_pii(F.col("text"))).alias("p"))
    return docs.select("doc_id", "p.kind", "p.start", "p.len").where(F.col("kind").isin(*RE2))


@query(f"""with c as ({sql('campaigns', 'duckdb')}), h as (select id as "row", 'copy' as "column", 'email' as kinds from c where id % 50 = 0), t as (select *, row_number() over (order by "row", "column") as k from h)
select "row", "column", kinds, (select count(*) from h) as cells from t where k <= 100""")
def pii_report(spark, d):
    c = view(spark, d, "campaigns").select("id", "segment", F.expr("if(id % 50 = 0, concat(copy, ' write to me@example.com'), copy)").alias("copy"))
    report, total = P.cell_report(c, "id")
    return report.select("row", "column", F.array_join("kinds", ",").alias("kinds")).crossJoin(F.broadcast(total.select("cells")))  # one row


# The whole study.
MCNEMAR = "case when model_only + human_only = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(model_only, human_only)::bigint + 1), lambda i: exp(lgamma(model_only + human_only + 1) - lgamma(i + 1) - lgamma(model_only + human_only - i + 1) - (model_only + human_only) * ln(2))))) end"


@query(f"""with {STUDY}, pa as (select participant, count(choice) as answered, list_sort(list(ms) filter (choice is not null))[count(choice) // 2 + 1] as mid from st group by participant),
ex as (select participant, answered, case when answered < 10 then 'too few answers' when mid < 500 then 'too fast' end as reason from pa),
g as (select case grouping(participant, paid) when 0 then 'participant' when 3 then 'pooled' else case when paid then 'professional' else 'lay' end end as level, participant, paid, count(distinct st.participant) as participants, count(*) as n, count(*) filter (choice = winner_position) as human_hits,
  count(*) filter (model_pick = winner_position) as model_hits, count(*) filter (model_pick = winner_position and choice <> winner_position) as model_only, count(*) filter (choice = winner_position and model_pick <> winner_position) as human_only
  from st join ex using (participant) where reason is null and choice is not null group by grouping sets ((participant, paid), (paid), ())),
m as (select case when count(*) filter (level = 'lay' and participants >= 3) > 0 and count(*) filter (level = 'professional') > 0 then 'professional' else 'pooled' end as main from g),
z as (select *, {wilson_sql('human_hits', 'n')} from g)
select level, participant, n, human_hits, model_hits, round(lo, 9) as lo, round(hi, 9) as hi, round({MCNEMAR}, 9) as p_value, lo > 0.5 as beats_chance, level = main as "primary", null::varchar as reason from z, m
union all select 'excluded', participant, answered, null, null, null, null, null, null, null, reason from ex where reason is not null""".replace("count(distinct st.participant)", "count(distinct participant)"))
def whole_study(spark, d):
    out = Q.whole_study(answers(spark, d), 10, 500)
    return out.select("level", "participant", "n", "human_hits", "model_hits", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "p_value")], "beats_chance", "primary", "reason")


# Tenants.
def newton_sql(steps: int) -> str:
    ctes = ["w0 as (select tenant_id, count(*) as n, 0.3::double as a, -0.2::double as b from x group by tenant_id)"]
    for s in range(steps):
        ctes.append(f"p{s} as (select x.tenant_id, x1, x2, 1 / (1 + exp(a * x1 + b * x2)) as p from x join w{s} using (tenant_id))")
        ctes.append(f"s{s} as (select tenant_id, sum(-p * x1) as g1, sum(-p * x2) as g2, sum(p * (1 - p) * x1 * x1) + 1 as h11, sum(p * (1 - p) * x1 * x2) as h12, sum(p * (1 - p) * x2 * x2) + 1 as h22 from p{s} group by tenant_id)")
        g1, g2 = "(g1 + a - 0.3)", "(g2 + b + 0.2)"
        ctes.append(f"w{s + 1} as (select tenant_id, n, a - ({g1} * h22 - {g2} * h12) / (h11 * h22 - h12 * h12) as a, b - ({g2} * h11 - {g1} * h12) / (h11 * h22 - h12 * h12) as b from w{s} join s{s} using (tenant_id))")
    return ", ".join(ctes)


@query(f"""with {PAIRS}, x as (select test_id % 40 as tenant_id, (length(hi_id) - length(lo_id)) / 10 as x1, (ascii(hi_id) - ascii(lo_id)) / 10 as x2 from pairs where test_id % 40 > 0 or gap > 0.8), {newton_sql(6)}, f as (select *, greatest(0, 1 - n / 200) as s from w6)
select tenant_id::bigint as tenant_id, n, round(s, 9) as shrinkage, round(s * 0.3 + (1 - s) * a, 6) as w1, round(s * -0.2 + (1 - s) * b, 6) as w2 from f""")
def tenant_recalibrate(spark, d):
    p = E.build_pairs(labelled(spark, d)).where("test_id % 40 > 0 or gap > 0.8")
    x = p.select((F.col("test_id") % 40).alias("tenant_id"), F.expr("(length(hi_id) - length(lo_id)) / 10d").alias("x1"), F.expr("(ascii(hi_id) - ascii(lo_id)) / 10d").alias("x2"))
    out = T.recalibrate(x, ["x1", "x2"], [0.3, -0.2])
    return out.select(F.col("tenant_id").cast("long").alias("tenant_id"), "n", F.round("shrinkage", 9).alias("shrinkage"), *[F.round(F.col("weights")[i], 6).alias(f"w{i + 1}") for i in (0, 1)])


@query("""with c as (select 'tenant-' || c_nationkey as tenant_id, c_custkey as id from customer)
select 'insert' as action, tenant_id, count(*)::bigint as n from c group by tenant_id
union all select 'read', 'tenant-7', count(*) from c where tenant_id = 'tenant-7'
union all select 'cross_tenant_denied', 'tenant-7', count(*) from c where tenant_id <> 'tenant-7' and id % 10 = 0
union all select 'got', 'tenant-7', count(*) from c where tenant_id = 'tenant-7' and id % 10 = 0""")
def tenant_audit(spark, d):
    """Every customer loaded as its tenant's row; one tenant lists its own and asks for every tenth id, whoever owns it."""
    path = folder(spark, "tenants")
    rows = view(spark, d, "tenant_rows").select(F.concat(F.lit("tenant-"), "tenant_id").alias("tenant_id"), F.col("seq").alias("id"), "payload")
    T.insert_all(rows, path, "loader", "customers")
    own = T.TenantTable(spark, path, "tenant-7", "someone", "customers", "id long, payload string")
    own.list()
    got = own.get(rows.where("id % 10 = 0"))
    log = T.audit_log(spark, path).groupBy("action", "tenant_id").agg(F.sum("n").alias("n"))
    return log.unionByName(got.agg(F.lit("got").alias("action"), F.lit("tenant-7").alias("tenant_id"), F.count("*").alias("n")))
