"""Experiment tables derived from the driver's tables; each is SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "arms": """select l_suppkey as test_id, p_name as arm_id, p_name as copy_text, cast(sum(l_quantity) as bigint) as impressions,
        cast(sum(case when l_returnflag = 'R' then l_linenumber else 0 end) as bigint) as clicks, min(l_shipdate) as created_at, min(l_linestatus) as release
        from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_name""",
    "arms_release": """select l_suppkey as test_id, p_name as arm_id, p_name as copy_text, l_linestatus as release, cast(sum(l_quantity) as bigint) as impressions,
        cast(sum(case when l_returnflag = 'R' then l_linenumber else 0 end) as bigint) as clicks
        from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_name, l_linestatus""",
    "arms_image": """select l_suppkey as test_id, concat(p_name, '/', p_brand, '/', p_type) as arm_id, p_name as copy_text, p_brand as image_id, p_type as lede, cast(sum(l_quantity) as bigint) as impressions,
        cast(sum(case when l_returnflag = 'R' then l_linenumber else 0 end) as bigint) as clicks
        from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_name, p_brand, p_type""",
    "closure_pass": """select distinct l_orderkey as test_id, concat('copy ', cast(l_partkey as string)) as copy_text, l_orderkey * 1000000 + l_partkey as row_id, min(l_shipdate) over (partition by l_orderkey, l_partkey) as created_at
        from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00' and l_shipdate < timestamp '1998-01-29 00:00:00'""",
    "closure_full": """select l_orderkey as test_id, concat('copy ', cast(l_partkey as string), ' ', cast(date_trunc('week', l_shipdate) as string)) as copy_text,
        min(l_orderkey * 10 + l_linenumber) as row_id, min(l_shipdate) as created_at from lineitem group by l_orderkey, l_partkey, date_trunc('week', l_shipdate)""",
    "closure_abort": "select l_suppkey as test_id, p_name as copy_text, min(l_orderkey * 10 + l_linenumber) as row_id from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_name",
    "stories": "select page_id as id, url from pages",
    "reposts": """select o_orderkey as id, o_custkey as url, o_orderpriority as title, cast(floor(o_totalprice / 1000) as bigint) as points, o_orderstatus as author,
        cast({epoch} as bigint) as created_at_i from orders""",
    "campaigns": """select o_orderkey as id, o_orderpriority as copy, cast(floor(o_totalprice) as bigint) % 5000 as impressions, o_orderkey % 700 as clicks, c_mktsegment as segment, c_nationkey as campaign
        from orders join customer on o_custkey = c_custkey""",
    "study": """select d.source as participant, d.doc_id as item, case when d.doc_id % 11 = 0 then null else l.quality end as choice, cast(d.doc_id % 2 as int) as winner_position, l.toxic as model_pick, d.n_chars as ms
        from labels l join documents d on l.doc_id = d.doc_id""",
    "predictions": """select o_orderkey as id, cast(o_orderkey % 2 as int) as predicted, case when o_orderstatus = 'P' then null else cast(o_custkey % 2 as int) end as actual,
        case when o_orderkey % 3 = 0 then null else cast((o_orderkey + o_custkey) % 2 as int) end as user_pick, o_totalprice / 100000 as margin, o_orderdate as created_at from orders""",
    "tenant_rows": "select cast(c_nationkey as string) as tenant_id, c_custkey as seq, concat(c_name, ' ', c_mktsegment) as payload from customer",
    "event_stream": """select event_id, ts, user_id % 20 as test_id, event_id % 4 as arm, 1 as impressions, case when event_type = 'click' then 1 else 0 end as clicks from events""",
}
SEEDS = [f"{d}_{s}" for s in "mfyolh" for d in ("valence", "arousal", "dominance")]
VIEWS["lexicon"] = "select word, round(1 + 8 * {hash:word:1}, 3) as valence, round(1 + 8 * {hash:word:2}, 3) as arousal, round(1 + 8 * {hash:word:3}, 3) as dominance, round(1 + 4 * {hash:word:4}, 3) as concreteness, " + ", ".join(
    f"round(1 + 8 * {{hash:word:{5 + i}}}, 3) as {n}" for i, n in enumerate(SEEDS)
) + " from (select distinct word from ({words})) where {hash:word:0} < 0.6"
WORDS = {
    "spark": "select explode(regexp_extract_all(lower(text), \"[a-z][a-z'-]*\", 0)) as word from documents where lang = 'en'",
    "duckdb": "select unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) as word from documents where lang = 'en'",
}
HASH = {
    "spark": r"(cast(conv(substring(md5(cast(concat_ws('|', \1, '\2') as binary)), 1, 13), 16, 10) as double) / pow(2, 52))",
    "duckdb": r"(('0x' || substr(md5(concat_ws('|', \1, '\2')), 1, 13))::bigint / pow(2, 52))",
}
EPOCH = {"spark": "unix_timestamp(o_orderdate)", "duckdb": "epoch(o_orderdate)"}
TABLES = ("lineitem", "part", "pages", "orders", "customer", "labels", "documents", "events", "embeddings", "supplier", "conversations")


def sql(name: str, engine: str) -> str:
    text = VIEWS[name].replace("{epoch}", EPOCH[engine]).replace("{words}", WORDS[engine])
    return re.sub(r"\{hash:(\w+):(\d+)\}", HASH[engine], text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of ``sf_dir``."""
    text = sql(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text}
    for t, df in used.items():
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **used)
