"""Site state and learned scores as folds over logs: retries, claims, progress, learning and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retry_budget

LEAST, MOST, DECAY_SECONDS = -12, 60, 14 * 24 * 60 * 60


def outcomes(log: DataFrame) -> DataFrame:
    """(site, status, retry_count, last_error) after log(site, attempt, error); a null error is a success.

    A failure is temporary while fewer retries than its budget were used, else the site is dropped; the
    errors in PERMANENT drop at once. No budget is above two, so a site's first three attempts settle its state and later ones
    are left out before anything is gathered.
    """
    first = Window.partitionBy("site").orderBy("attempt", "error")
    log = log.withColumn("place", F.row_number().over(first)).where("place <= 3")
    steps = F.array_sort(F.collect_list(F.struct("attempt", "error", retry_budget("error").alias("budget"), is_permanent(F.col("error")).alias("final"))))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("retries"), F.lit("").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["status"].isin("done", "dropped")
        status = F.when(x["error"].isNull(), "done").when(x["final"] | (acc["retries"] >= x["budget"]), "dropped").otherwise("failed_temp")
        more = F.when(x["error"].isNull() | x["final"], 0).otherwise(1)
        return F.when(over, acc).otherwise(F.struct(status.alias("status"), (acc["retries"] + more).alias("retries"), F.coalesce(x["error"], F.lit("")).alias("error")))

    return log.groupBy("site").agg(F.aggregate(steps, start, step).alias("s")).select("site", "s.status", F.col("s.retries").alias("retry_count"), F.col("s.error").alias("last_error"))


def is_permanent(error: Column) -> Column:
    return F.coalesce(error.rlike("(?i)http_40[134]|_challenge|could not resolve host|connection refused"), F.lit(False))


def claim_order(sites: DataFrame, n: int) -> DataFrame:
    """The next n sites of sites(site, input_index, status, retry_count): pending ones first, then failed ones, by input_index."""
    return sites.where(F.col("status").isin("pending", "failed_temp")).orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), "input_index").limit(n)


def progress(sites: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "failed_temp", "done", "dropped")]
    return sites.agg(*counts, F.count("*").alias("total"))


def reset(sites: DataFrame) -> DataFrame:
    """Running sites are pending again."""
    return sites.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def merge(sites: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """sites with the columns of updates(site, columns) where there is an update."""
    new = updates.select("site", F.struct(*columns).alias("__new"))
    out = sites.join(new, "site", "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in sites.columns])


def delivery(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Rows for delivery: finished sites in input order."""
    done = sites.where(F.col("status").isin("done", "dropped")).select("site", "input_index")
    rows = done.join(results, "site", "left").orderBy("input_index")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("company_name", "representative", "emails", "phones")], F.col("site").alias("website"))


# Every step x -> least(greatest(x + d, lo), hi) is a clamp of a shift, and clamps of shifts compose into another.
# So a long log folds in any grouping; three numbers stand for any number of steps.
def compose(acc: Column, x: Column) -> Column:
    lo = F.least(F.greatest(acc["lo"] + x["add"], x["lo"]), x["hi"])
    hi = F.least(F.greatest(acc["hi"] + x["add"], x["lo"]), x["hi"])
    return F.struct((acc["add"] + x["add"]).alias("add"), lo.alias("lo"), hi.alias("hi"))


def fold_scores(events: DataFrame, chunk: int = 4096) -> DataFrame:
    """(kind, feature, score) of events(kind, feature, seq, delta), clamped to -12..60 after each but the first step.

    The first step of a feature sets its score. Events are folded in chunks of neighbouring seq, so a feature with
    very many events is no large group; the chunks' summaries are folded again.
    """
    first = events.groupBy("kind", "feature").agg(F.min("seq").alias("first"))
    rows = events.join(first, ["kind", "feature"]).withColumn("part", F.floor(F.col("seq") / chunk))
    big = F.lit(2**40)
    one = F.struct(F.col("delta").cast("long").alias("add"), F.when(F.col("seq") == F.col("first"), -big).otherwise(LEAST).cast("long").alias("lo"), F.when(F.col("seq") == F.col("first"), big).otherwise(MOST).cast("long").alias("hi"))
    identity = F.struct(F.lit(0).cast("long").alias("add"), (-big).cast("long").alias("lo"), big.cast("long").alias("hi"))

    def fold(order: str, value: Column) -> Column:
        return F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("x")))), lambda z: z["x"]), identity, compose)

    parts = rows.groupBy("kind", "feature", "part").agg(fold("seq", one).alias("x"))
    whole = parts.groupBy("kind", "feature").agg(fold("part", F.col("x")).alias("x"))
    score = F.least(F.greatest(F.col("x.add"), F.col("x.lo")), F.col("x.hi"))
    return whole.select("kind", "feature", score.cast("int").alias("score"))


def decayed(score: Column, updated: Column, now: Column) -> Column:
    """Positive scores lose one for each full 14 days, down to 1; others stay, as do those with an unreadable time."""
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(updated, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0))
    windows = F.floor(seconds / DECAY_SECONDS)
    return F.when((score > 0) & (F.coalesce(windows, F.lit(0)) > 0), F.greatest(score - windows, F.lit(1))).otherwise(score).cast("int")


def islands(spans: DataFrame, keys: list[str], gap: int, most: int | None = None) -> DataFrame:
    """(keys, n, lo, hi): spans(keys, lo, hi) joined where they are at most `gap` apart, the first `most` of them."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("lo") > F.max("hi").over(before) + gap) | F.max("hi").over(before).isNull()
    rows = spans.withColumn("n", F.sum(new.cast("int")).over(Window.partitionBy(*keys).orderBy("lo", "hi")))
    out = rows.groupBy(*keys, "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.where(F.col("n") <= most) if most else out


def claim(sites: DataFrame, n: int) -> DataFrame:
    """sites with the first n of claim_order marked as running."""
    taken = claim_order(sites, n).select("site", F.lit(True).alias("claimed"))
    rows = sites.join(taken, "site", "left")
    return rows.withColumn("status", F.when(F.col("claimed"), "running").otherwise(F.col("status"))).drop("claimed")


def rerun(sites: DataFrame) -> DataFrame:
    """sites with every status pending if all are finished, else as they are."""
    total, finished = sites.agg(F.count("*"), F.count_if(F.col("status").isin("done", "dropped"))).first()
    return sites.withColumn("status", F.lit("pending")) if total and total == finished else sites


def prepare(stored: DataFrame, job: tuple[str, str], name: str, fingerprint: str, rows: DataFrame) -> DataFrame:
    """The stored sites if the job (name, fingerprint) is the same and holds any; else the rows anew, pending and with no retries."""
    if job == (name, fingerprint) and not stored.isEmpty():
        return stored
    return rows.withColumn("status", F.lit("pending")).withColumn("retry_count", F.lit(0))


def probe_batches(batches: DataFrame, target: int = 8, patience: int = 2, least: int = 2) -> DataFrame:
    """(site, batch, hits): those of batches(site, batch, hits) that are tried, in order, before the search of a site stops.

    It stops after the batch that brings the hits to `target`, after `patience` empty batches on end, or where `patience`
    batches or more have brought fewer than `least` hits. Rows of one site and batch are one batch; null hits are none.
    """
    rows = batches.where("batch is not null").groupBy("site", "batch").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
    so_far = Window.partitionBy("site").orderBy("batch")
    rows = rows.withColumn("n", F.row_number().over(so_far))
    found, last = F.sum("hits").over(so_far), F.coalesce(F.max(F.when(F.col("hits") > 0, F.col("n"))).over(so_far), F.lit(0))
    rows = rows.withColumn("ends", (found >= target) | (F.col("n") - last >= patience) | ((F.col("n") >= patience) & (found < least)))
    ended = F.coalesce(F.max("ends").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("ended", ended).where(~F.col("ended")).select("site", "batch", "hits")


def clean_features(features: Column) -> Column:
    """Features trimmed and in lower case, each once, in order; blank and null ones are none."""
    low = F.transform(features, lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return F.array_distinct(F.filter(low, lambda x: x != ""))


def bump_tokens(known: DataFrame, batches: DataFrame) -> DataFrame:
    """(kind, token, weight): known(kind, token, weight) with one more for each time that batches(kind, tokens) name a token.

    A token is counted as often as a batch names it. Both sides are added up before they are shuffled, so a hot token costs
    one row for each task.
    """
    named = batches.select("kind", F.explode(F.transform("tokens", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))).alias("token")).where("token <> ''")
    both = known.select("kind", "token", F.coalesce(F.col("weight").cast("long"), F.lit(0)).alias("weight")).unionByName(named.select("kind", "token", F.lit(1).cast("long").alias("weight")))
    return both.groupBy("kind", "token").agg(F.sum("weight").alias("weight"))


def token_order() -> list[Column]:
    """The order in which learned tokens are read: heaviest first."""
    return [F.desc("weight"), F.asc("token")]


def record(stored: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(kind, feature, score, updated): stored(kind, feature, score, updated) after events(kind, seq, features, delta).

    A stored score decays by its time first and is then the first step of its feature; of an event's features each counts once.
    Features without an event keep their score and time.
    """
    steps = events.select("kind", F.col("seq").cast("long").alias("seq"), F.explode(clean_features(F.col("features"))).alias("feature"), F.col("delta").cast("long").alias("delta"))
    touched = steps.select("kind", "feature").distinct()
    known = stored.withColumn("score", decayed(F.col("score"), F.col("updated"), now))
    before = known.join(touched, ["kind", "feature"], "left_semi").select("kind", F.lit(None).cast("long").alias("seq"), "feature", F.col("score").cast("long").alias("delta"))
    least = steps.groupBy("kind", "feature").agg((F.min("seq") - 1).alias("first"))
    before = before.join(least, ["kind", "feature"]).select("kind", F.col("first").alias("seq"), "feature", "delta")
    fresh = fold_scores(steps.unionByName(before)).withColumn("updated", F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    return known.join(touched, ["kind", "feature"], "left_anti").select("kind", "feature", "score", "updated").unionByName(fresh)


def load_scores(stored: DataFrame, now: Column) -> DataFrame:
    """(kind, place, feature, score): decayed scores other than zero, the highest first within their kind; `place` from 1.

    The place is a rank within blocks of equal scores plus the sizes of the blocks above, as a kind may hold any number of features.
    """
    rows = stored.select("kind", "feature", decayed(F.col("score"), F.col("updated"), now).alias("score")).where("score <> 0")
    sizes = rows.groupBy("kind", "score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("kind").orderBy(F.desc("score"))) - F.col("n")
    own = F.row_number().over(Window.partitionBy("kind", "score").orderBy("feature"))
    rows = rows.withColumn("own", own).join(sizes.withColumn("above", above), ["kind", "score"])
    return rows.select("kind", (F.col("own") + F.col("above")).alias("place"), "feature", "score")
