"""Learned state per host.

The score fold is order-dependent, yet associative once a stretch of events is described by what it does to
*any* incoming state. Within one lane an event maps a score s to max(0, s + delta), where 0 means "absent"; a
chain of such maps is again of the form max(low, s + total). A stretch is therefore fully described by

    lane    lane of its first run
    total   sum of deltas in the first run
    low     lower bound the first run imposes
    other   score after the first run when the incoming entry was of another lane (it restarts at 1)
    single  the stretch has only that one run
    alive   final entry when the first run ends with a positive score
    dead    final entry when it ends with none

and two adjacent descriptions combine into one. A host's history is cut into seconds, each second described on
its own, the descriptions of an hour combined, and only the hours chained. A host holding a third of all events is
spread over all its seconds, and what meets in one task is bounded by time, not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.urls import norm_host, path
from ..rules import DEFAULT_RULES, Rules

ENTRY = "struct<decision:string,score:int>"


def _entry(decision: Column, score: Column) -> Column:
    return F.struct(decision.cast("string").alias("decision"), score.cast("int").alias("score"))


def _none() -> Column:
    return F.struct(F.lit(None).cast("string").alias("decision"), F.lit(0).alias("score"))


def _apply(state: Column, e: Column) -> Column:
    """One event on one entry (D2: failures count -1; D22: a lane switch restarts at 1 even on failure)."""
    absent, same = state["score"] <= 0, state["decision"] == e["lane"]
    score = (F.when(absent, F.greatest(e["delta"], F.lit(0)))
             .when(same, F.greatest(state["score"] + e["delta"], F.lit(0))).otherwise(F.lit(1)))
    lane = F.when(absent & (e["delta"] <= 0), F.lit(None).cast("string")).otherwise(e["lane"])
    return _entry(lane, score)


def describe(events: Column) -> Column:
    """Description of an ordered, non-empty array of (lane, delta) events."""
    first = events[0]

    def clamp(x: Column) -> Column:
        return F.greatest(x, F.lit(0)).cast("int")

    start = F.struct(
        first["lane"].alias("lane"), first["delta"].cast("int").alias("total"), F.lit(0).alias("low"),
        F.lit(1).alias("other"), F.lit(True).alias("single"), _none().alias("alive"), _none().alias("dead"))

    def step(acc: Column, e: Column) -> Column:
        d = e["delta"].cast("int")
        in_first = acc["single"] & (e["lane"] == acc["lane"])
        grown = F.struct(acc["lane"].alias("lane"), (acc["total"] + d).alias("total"), clamp(acc["low"] + d).alias("low"),
                         clamp(acc["other"] + d).alias("other"), F.lit(True).alias("single"),
                         acc["alive"].alias("alive"), acc["dead"].alias("dead"))
        # First event of the second run: a living entry of another lane restarts at 1.
        alive = F.when(acc["single"], _entry(e["lane"], F.lit(1))).otherwise(_apply(acc["alive"], e))
        dead = F.when(acc["single"], _apply(_none(), e)).otherwise(_apply(acc["dead"], e))
        later = F.struct(acc["lane"].alias("lane"), acc["total"].alias("total"), acc["low"].alias("low"),
                         acc["other"].alias("other"), F.lit(False).alias("single"),
                         alive.alias("alive"), dead.alias("dead"))
        return F.when(in_first, grown).otherwise(later)

    return F.aggregate(F.slice(events, F.lit(2), F.greatest(F.size(events) - 1, F.lit(0))), start, step)


def chain(state: Column, d: Column) -> Column:
    """Entry after a described stretch."""
    def after_first_run(s: Column) -> Column:
        end = (F.when(s["score"] <= 0, F.greatest(d["low"], d["total"]))
               .when(s["decision"] == d["lane"], F.greatest(d["low"], s["score"] + d["total"]))
               .otherwise(d["other"]))
        return F.greatest(end, F.lit(0)).cast("int")

    def entry(end: Column) -> Column:
        lone = _entry(F.when(end > 0, d["lane"]), end)
        return F.when(d["single"], lone).when(end > 0, d["alive"]).otherwise(d["dead"])

    return let(let(state, after_first_run), entry)


def combine(a: Column, b: Column) -> Column:
    """Description of two adjacent stretches."""
    same = a["single"] & (a["lane"] == b["lane"])
    joined = F.struct(a["lane"].alias("lane"), (a["total"] + b["total"]).alias("total"),
                      F.greatest(b["low"], a["low"] + b["total"]).alias("low"),
                      F.greatest(b["low"], a["other"] + b["total"]).alias("other"), b["single"].alias("single"),
                      b["alive"].alias("alive"), b["dead"].alias("dead"))
    alive = F.when(a["single"], _entry(a["lane"], F.lit(1))).otherwise(a["alive"])
    dead = F.when(a["single"], _none()).otherwise(a["dead"])
    later = F.struct(a["lane"].alias("lane"), a["total"].alias("total"), a["low"].alias("low"), a["other"].alias("other"),
                     F.lit(False).alias("single"), chain(alive, b).alias("alive"), chain(dead, b).alias("dead"))
    return F.when(same, joined).otherwise(later)


PIECE = 1 << 14  # events that meet in one array


def block_descriptions(events: DataFrame, bucket_s: int = 1, block_s: int = 3600, piece: int = PIECE) -> DataFrame:
    """One description per host and block, made of those of its short buckets.

    A bucket is cut into pieces of ``piece`` events by their number in it (a sort that spills), so that a bucket with
    millions of events, as where times are dates only, is in no array; a block's array holds its pieces.
    """
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_s)
    rows = events.select("host", at.alias("bucket"), "ts", "event_id", "lane", F.col("delta").cast("int").alias("delta"))
    number = F.row_number().over(Window.partitionBy("host", "bucket").orderBy("ts", "event_id", "lane", "delta"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "lane", "delta")))
    pieces = (rows.withColumn("piece", F.floor((number - 1) / piece)).groupBy("host", "bucket", "piece").agg(ordered.alias("es"))
              .select("host", "bucket", "piece", describe(F.col("es")).alias("d"), F.size("es").alias("n"),
                      F.element_at("es", -1)["ts"].alias("updated")))
    block = F.floor(F.col("bucket") * bucket_s / max(bucket_s, block_s))
    ds = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "piece", "d"))), lambda x: x["d"])
    long = pieces.groupBy("host", block.alias("bucket")).agg(ds.alias("ds"), F.sum("n").alias("n"), F.max("updated").alias("updated"))
    rest = F.slice("ds", F.lit(2), F.greatest(F.size("ds") - 1, F.lit(0)))
    return long.select("host", "bucket", F.aggregate(rest, F.get("ds", F.lit(0)), combine).alias("d"), "n", "updated")


def fold_scores(events: DataFrame, state0: DataFrame | None = None, bucket_s: int = 1, block_s: int = 3600) -> DataFrame:
    """The entry of every host of the events or of ``state0`` after all events; score 0 where it has none any more."""
    parts = block_descriptions(events, bucket_s, block_s).groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "d"))).alias("ds"), F.sum("n").alias("events"),
        F.max("updated").alias("updated"))
    if state0 is None:
        joined = parts.select(F.col("host").alias("cache_key"), "ds", "events", "updated", _none().alias("s0"))
    else:
        old = state0.select("cache_key", "decision", "score")
        joined = parts.join(old, parts["host"] == old["cache_key"], "full").select(
            F.coalesce("host", "cache_key").alias("cache_key"), "ds", "events", "updated",
            F.when(F.coalesce(F.col("score"), F.lit(0)) > 0, _entry(F.col("decision"), F.col("score")))
            .otherwise(_none()).alias("s0"))
    end = F.aggregate(F.coalesce("ds", F.array().cast(parts.schema["ds"].dataType)),
                      F.col("s0"), lambda s, x: chain(s, x["d"]))
    return (joined.select("cache_key", end.alias("e"), F.coalesce("events", F.lit(0)).alias("events"), "updated")
            .select("cache_key", F.col("e.decision").alias("decision"), F.col("e.score").alias("score"), "events", "updated"))


def learn_scores(events: DataFrame, state0: DataFrame | None = None, bucket_s: int = 1, block_s: int = 3600) -> DataFrame:
    """L1: learned entry per host after all its events (``host, ts, event_id, lane, delta``) in time order.

    ``state0`` (``cache_key, decision, score``) is the earlier state; entries whose host has no event stay.
    """
    return fold_scores(events, state0, bucket_s, block_s).filter(F.col("score") > 0)


def attempt_events(attempts: DataFrame) -> DataFrame:
    """One +1 or -1 event per recorded attempt; lane names are kept."""
    lane = F.when(F.col("lane") == "easyget_pdf", "pdf").otherwise(F.col("lane"))
    return attempts.select("host", "ts", F.col("attempt_id").alias("event_id"), lane.alias("lane"),
                           F.when(F.col("success"), 1).otherwise(-1).alias("delta"))


def resolved_events(winners: DataFrame, failures: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One event per resolved request (D2, D3, D5): +1 for the winning lane; where every lane failed +1 for ``blocked``,
    or, for a URL that looks like a PDF, -1 for ``pdf``."""
    from ..functions.urls import is_pdf_url

    won = winners.select("host", "ts", F.col("request_id").alias("event_id"), "lane", F.lit(1).alias("delta"))
    pdf = is_pdf_url("url", rules)
    lost = failures.select("host", "ts", F.col("request_id").alias("event_id"), F.when(pdf, "pdf").otherwise("blocked").alias("lane"),
                           F.when(pdf, -1).otherwise(1).alias("delta"))
    return won.unionByName(lost)


def learn_pdf_hosts(events: DataFrame, known_hosts: DataFrame, threshold: int = 3) -> DataFrame:
    """L3: PDF success counts per host; ``learned`` marks hosts that reach the threshold and are new."""
    stats = events.groupBy("host").agg(
        F.count("*").alias("total_attempts"), F.count_if("success").alias("success_count"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    known = known_hosts.select("host").distinct().withColumn("_known", F.lit(True))
    return stats.join(known, "host", "left").select(
        *stats.columns, (F.col("_known").isNull() & (F.col("success_count") >= threshold)).alias("learned"))


def learn_pdf_paths(events: DataFrame, known_hosts: DataFrame, rules: Rules = DEFAULT_RULES,
                    threshold: int | None = None) -> DataFrame:
    """L4: path prefixes ending in a ``pdf`` segment, from the event that makes a host learned.

    Only the threshold-th success of a host matters; the ranked limit is applied before the shuffle.
    """
    k = threshold or rules.pdf_learn_threshold
    order = Window.partitionBy("host").orderBy("ts", "event_id")
    base = events.filter("success").select("host", "url", "ts", "event_id")
    hits = base.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k)
    hits = hits.join(known_hosts.select("host").distinct(), "host", "left_anti")
    parts = F.split(path("url"), "/")
    rows = hits.select("host", parts.alias("parts"), F.posexplode(parts).alias("i", "part"))
    found = rows.filter(F.lower("part").contains("pdf")).select(
        "host", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "/"), F.lit("/")).alias("pattern"))
    return found.filter(~F.col("pattern").isin(*rules.pdf_patterns)).distinct()


def pdf_events(attempts: DataFrame) -> DataFrame:
    """PDF fetch outcomes per URL as learning events."""
    return attempts.select(norm_host("url").alias("host"), "url", "ts", F.col("attempt_id").alias("event_id"), "success")


def merge_state(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Union of two states; the newer entry wins per key."""
    cols = [c for c in older.columns if c != "cache_key"]
    both = older.withColumn("_src", F.lit(0)).unionByName(newer.withColumn("_src", F.lit(1)))
    return both.groupBy("cache_key").agg(F.max_by(F.struct(*cols), F.col("_src")).alias("e")).select("cache_key", "e.*")


def cap_state(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest entries. A cut of learned state must be asked for, so ``n`` has no default."""
    return state.orderBy(F.desc("updated"), "cache_key").limit(n)


def state_stats(state: DataFrame, pdf_hosts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row of sizes, per-decision counts and thresholds."""
    # Both inputs go through one aggregate, so that no two one-row results need joining.
    rows = state.select("decision", "score", F.lit(True).alias("entry")).unionByName(
        pdf_hosts.filter("learned").select(F.lit(None).cast("string").alias("decision"), F.lit(None).cast("int").alias("score"),
                                           F.lit(False).alias("entry")))
    by = [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("easyget", "playwright", "jina", "pdf", "blocked")]
    sizes = rows.agg(F.count_if("entry").alias("cache_size"), *by, F.coalesce(F.sum("score"), F.lit(0)).alias("total_score"),
                     F.count_if(~F.col("entry")).alias("learned_pdf_hosts"))
    fixed = {"spa_hosts": len(rules.spa_hosts), "spa_patterns": len(rules.spa_patterns), "pdf_hosts": len(rules.pdf_hosts),
             "pdf_patterns": len(rules.pdf_patterns), "body_text_threshold": rules.body_text_threshold,
             "script_count_threshold": rules.script_count_threshold, "min_criteria_match": rules.min_criteria_match,
             "pdf_learn_threshold": rules.pdf_learn_threshold}
    return sizes.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
