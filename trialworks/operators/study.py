"""Uploads, quiz studies, sealed predictions and their track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialworks.functions import stats as S
from trialworks.functions import text as X


def campaign_reason(min_impressions: int = 500) -> Column:
    """First rule that a campaign row breaks, or null."""
    n, c = X.clean_number(F.col("impressions").cast("string")), X.clean_number(F.col("clicks").cast("string"))
    return (
        F.when(F.coalesce(F.trim("copy"), F.lit("")) == "", "empty copy").when(n.isNull() | c.isNull(), "not a number")
        .when(n < min_impressions, "too few impressions").when((c < 0) | (c > n), "clicks out of range")
    )


def validate_campaigns(df: DataFrame, min_impressions: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their reason)."""
    judged = df.withColumn("reason", campaign_reason(min_impressions))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def exclusions(df: DataFrame, min_answered: int = 24, min_ms: int = 2000) -> DataFrame:
    """(participant, answered, mid, reason): who is left out and why; null reason for those who stay. Blind to accuracy.

    ``mid`` is the upper median of the answers' times (the one at half their number, counted from 0), found from counts per
    time, so that a participant with a third of all answers is not one array. Without any time it is null and excludes none.
    """
    done = df.where("choice is not null")
    answered = done.groupBy("participant").agg(F.count("*").alias("answered"), F.count("ms").alias("timed"))
    times = done.where("ms is not null").groupBy("participant", "ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("participant").orderBy("ms")
    upto = times.withColumn("upto", F.sum("n").over(w)).join(answered.select("participant", "timed"), "participant")
    mid = upto.where(F.col("upto") > F.floor(F.col("timed") / 2)).groupBy("participant").agg(F.min("ms").alias("mid"))
    all_ = df.select("participant").distinct().join(answered, "participant", "left").join(mid, "participant", "left")
    few = F.coalesce("answered", F.lit(0)) < min_answered
    return all_.select("participant", F.coalesce("answered", F.lit(0)).alias("answered"), "mid", F.when(few, "too few answers").when(F.col("mid") < min_ms, "too fast").alias("reason"))


def exclude_responses(df: DataFrame, min_answered: int = 24, min_ms: int = 2000) -> DataFrame:
    """Participants' answers, without those who answered too little or too fast (upper median); blind to accuracy."""
    return df.join(exclusions(df, min_answered, min_ms).where("reason is null").select("participant"), "participant", "left_semi")


def whole_study(answers: DataFrame, min_answered: int = 24, min_ms: int = 2000, least_lay: int = 3) -> DataFrame:
    """The study's table: a row for each participant, for professionals and for lay people, and for all of them pooled.

    ``answers``: participant, paid, item, choice, winner_position, model_pick, ms. Each row has level, participant, paid,
    participants, n, human_hits, model_hits, model_only, human_only, rates, both Wilson intervals, the exact p-value and
    ``beats_chance``; one row is primary: the professionals' where ``least_lay`` lay participants or more are left besides
    some professional, else the pooled one. Excluded participants are rows of level ``excluded`` with their reason and no
    scores. A null ``paid`` is lay. Sums are grouping sets over one pass of the answers.
    """
    out = exclusions(answers, min_answered, min_ms)
    rows = answers.where("choice is not null").withColumn("paid", F.coalesce("paid", F.lit(False)))
    rows = rows.join(out.where("reason is null").select("participant"), "participant", "left_semi")
    human, model = F.col("choice") == F.col("winner_position"), F.coalesce(F.col("model_pick") == F.col("winner_position"), F.lit(False))
    per = rows.groupBy("participant", "paid").agg(  # of everyone, before the sets: what is summed below is a row a participant
        F.count("*").alias("n"), F.count_if(human).alias("human_hits"), F.count_if(model).alias("model_hits"), F.count_if(model & ~human).alias("model_only"), F.count_if(human & ~model).alias("human_only"))
    sums = [F.count_distinct("participant").alias("participants"), *[F.sum(c).alias(c) for c in ("n", "human_hits", "model_hits", "model_only", "human_only")]]
    sets = per.groupingSets([["participant", "paid"], ["paid"], []], "participant", "paid").agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 0, "participant").when(F.col("g") == 3, "pooled").when(F.col("paid"), "professional").otherwise("lay")
    scored = sets.where("n is not null").withColumn("level", level).drop("g")
    lo, hi = S.wilson("human_hits", "n")
    model_lo, model_hi = S.wilson("model_hits", "n")
    scored = scored.withColumns({"human_rate": F.col("human_hits") / F.col("n"), "model_rate": F.col("model_hits") / F.col("n"), "lo": lo, "hi": hi, "model_lo": model_lo, "model_hi": model_hi, "p_value": S.mcnemar_exact("model_only", "human_only")})
    scored = scored.withColumn("beats_chance", F.col("lo") > 0.5)
    people = scored.agg(F.max(F.when(F.col("level") == "professional", F.col("participants"))).alias("pros"), F.max(F.when(F.col("level") == "lay", F.col("participants"))).alias("lays"))
    choice = F.when((F.coalesce("lays", F.lit(0)) >= least_lay) & (F.coalesce("pros", F.lit(0)) > 0), "professional").otherwise("pooled")
    scored = scored.crossJoin(F.broadcast(people.select(choice.alias("main")))).withColumn("primary", F.col("level") == F.col("main")).drop("main")  # one row
    gone = out.where("reason is not null").select(F.lit("excluded").alias("level"), "participant", F.col("answered").alias("n"), "reason")
    return scored.unionByName(gone, allowMissingColumns=True)


def score_study(answers: DataFrame) -> DataFrame:
    """Per participant: answered items, human and model hits, discordant counts, interval and exact test."""
    human, model = F.col("choice") == F.col("winner_position"), F.col("model_pick") == F.col("winner_position")
    out = answers.where("choice is not null").groupBy("participant").agg(
        F.count("*").alias("n"), F.count_if(human).alias("human_hits"), F.count_if(model).alias("model_hits"), F.count_if(model & ~human).alias("model_only"), F.count_if(human & ~model).alias("human_only"))
    lo, hi = S.wilson("human_hits", "n")
    return out.withColumns({"lo": lo, "hi": hi, "p_value": S.mcnemar_exact("model_only", "human_only")})


SEALED = ["id", "created_at", "variants", "predicted_winner", "tier", "margin", "user_pick"]


def seal(df: DataFrame) -> DataFrame:
    """Adds hash over the fields that are known before the outcome, in a fixed order."""
    return df.withColumn("hash", F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c != "variants" else F.col(c) for c in SEALED])), 256))


def verify_seal(df: DataFrame) -> DataFrame:
    """Adds intact: whether the stored hash still fits the fields. Outcomes recorded later do not break it."""
    return seal(df.withColumnRenamed("hash", "stored")).withColumn("intact", F.col("hash") == F.col("stored")).drop("hash").withColumnRenamed("stored", "hash")


def track_record(predictions: DataFrame, floor: int = 10) -> DataFrame:
    """One row: totals, and the model's and the users' boards with intervals and verdicts."""
    done, right = F.col("actual").isNotNull(), F.col("predicted") == F.col("actual")
    user = done & F.col("user_pick").isNotNull()
    out = predictions.agg(F.count("*").alias("total"), F.count_if(~done).alias("pending"), F.count_if(done).alias("model_n"), F.count_if(done & right).alias("model_hits"),
                          F.count_if(user).alias("user_n"), F.count_if(user & (F.col("user_pick") == F.col("actual"))).alias("user_hits"))
    for who in ("model", "user"):
        lo, hi = S.wilson(f"{who}_hits", f"{who}_n")
        out = out.withColumns({f"{who}_rate": F.col(f"{who}_hits") / F.nullif(f"{who}_n", F.lit(0)), f"{who}_lo": lo, f"{who}_hi": hi, f"{who}_below_floor": F.col(f"{who}_n") < floor})
        out = out.withColumn(f"{who}_beats_chance", (F.col(f"{who}_lo") > 0.5) & ~F.col(f"{who}_below_floor"))
    return out


def export_allow_list(predictions: DataFrame) -> DataFrame:
    """Resolved predictions, and of them only what may leave: no text, no id."""
    p = predictions.where("actual is not null")
    return p.select("hash", F.date_format("created_at", "yyyy-MM-dd").alias("date"), F.size("variants").alias("variant_count"), "tier", F.round("margin", 4).alias("margin"),
                    (F.col("predicted") == F.col("actual")).alias("model_correct"), (F.col("user_pick") == F.col("actual")).alias("user_correct"))


def audit_chain(entries: DataFrame) -> DataFrame:
    """Adds prev_hash and hash per tenant: each hash covers its predecessor, in the order of seq and payload.

    A tenant's chain is sequential by nature: its rows pass one task as a sorted stream, of which only the last hash is held.
    Of other columns none is kept; null sequence numbers come first and, like null payloads, add nothing to what is hashed.
    """
    kinds = dict(entries.dtypes)

    def run(batches):
        import hashlib

        import pyarrow as pa

        tenant, last, begun = None, "", False
        for b in batches:
            before, after = [], []
            for t, seq, payload in zip(b.column("tenant_id").to_pylist(), b.column("seq").to_pylist(), b.column("payload").to_pylist()):
                if not begun or t != tenant:
                    tenant, last, begun = t, "", True
                before.append(last)
                last = hashlib.sha256("|".join([last, *(str(x) for x in (seq, payload) if x is not None)]).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tenant_id", "seq", "payload")), pa.array(before, pa.string()), pa.array(after, pa.string())], ["tenant_id", "seq", "payload", "prev_hash", "hash"])

    rows = entries.select("tenant_id", "seq", "payload").repartition("tenant_id").sortWithinPartitions("tenant_id", "seq", "payload")
    return rows.mapInArrow(run, f"tenant_id {kinds['tenant_id']}, seq {kinds['seq']}, payload {kinds['payload']}, prev_hash string, hash string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per tenant the first broken position, from 1; null for a whole chain."""
    w = Window.partitionBy("tenant_id").orderBy("seq")
    want = F.sha2(F.concat_ws("|", F.coalesce(F.lag("hash").over(w), F.lit("")), F.col("seq").cast("string"), F.col("payload")), 256)
    bad = chain.withColumns({"at": F.row_number().over(w), "ok": (F.col("hash") == want) & (F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit("")))})
    return bad.groupBy("tenant_id").agg(F.count("*").alias("entries"), F.min(F.when(~F.col("ok"), F.col("at"))).alias("first_broken"))


def balanced_quiz(pairs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n pairs by hash order; the winner stands first in exactly half of them (rounded down)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("test_id", "hi_id", "lo_id")])
    h = lambda s: F.md5(F.concat_ws(":", key, F.lit(str(s))).cast("binary"))
    top = pairs.withColumn("h", h(seed)).orderBy("h").limit(n)  # a sample of n is the feature
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(h(seed + 1)))
    return top.withColumn("winner_position", F.when(at <= n // 2, 0).otherwise(1)).drop("h")
