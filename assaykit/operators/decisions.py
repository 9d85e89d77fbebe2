"""What landed replies decide: a note from its facts' verdicts, sites that may carry a change, findings folded over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.text import flat


def quoted(quote: Column, body: Column, least: int = 8, head: int = 60) -> Column:
    """Whether a quote of ``least`` characters or more stands in a text, whole or by its head; both flattened before."""
    return (F.length(quote) >= least) & (F.contains(body, quote) | F.contains(body, F.substring(quote, 1, head)))


def decide(facts: DataFrame, checked: DataFrame, retried: DataFrame, refuted: DataFrame, texts: DataFrame, credit: dict[str, float]) -> DataFrame:
    """One decision for each note: facts (note, fact, weight), verdicts (note, fact, verdict) of the check and of one retry, claims
    of the refuter (note, fact, found, quote), and texts (note, text).

    A retry answers only what the check left open. A note with an open fact afterwards has no aggregate. Otherwise a claim turns
    an absent fact into what was found, if its quote stands in the text; the aggregate is the weighted mean of the credits.
    """
    met = facts.join(checked.select("note", "fact", F.col("verdict").alias("_c")), ["note", "fact"], "left").join(retried.select("note", "fact", F.col("verdict").alias("_r")), ["note", "fact"], "left")
    asked = refuted.where("found <> 'no'").join(texts, "note")
    claims = asked.select("note", "fact", "found", F.coalesce(quoted(flat(F.col("quote")), flat(F.col("text"))), F.lit(False)).alias("_held"))
    met = met.join(claims, ["note", "fact"], "left").withColumn("_v", F.coalesce("_c", "_r"))
    rescued = (F.col("_v") == "absent") & F.coalesce("_held", F.lit(False))
    unproved = (F.col("_v") == "absent") & F.col("found").isNotNull() & ~F.col("_held")
    worth = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in credit.items() for x in kv)), F.coalesce(F.when(rescued, F.col("found")), F.col("_v"), F.lit(""))), F.lit(0.0))
    per = met.groupBy("note").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("_v").isNull()).alias("n_open"), F.bool_or(F.col("_c").isNull()).alias("retried"),
        F.count_if(F.col("_v") == "absent").alias("_absent"), F.count_if(rescued).alias("_flips"), F.count_if(unproved).alias("_unproved"),
        (F.sum(F.col("weight") * worth) / F.sum("weight")).alias("_mean"),
    )
    whole = F.col("n_open") == 0
    return per.select("note", "n_facts", "n_open", "retried", *(F.when(whole, F.col(f"_{c}")).alias(c) for c in ("absent", "flips", "unproved")), F.when(whole, F.col("_mean")).alias("aggregate"))


def survivors(sites: DataFrame, fact: str, strong: tuple[str, ...], weak: str) -> DataFrame:
    """(fact, n_sites, eligible, strong_site, weak_site) from sites (fact, site, strength, start, end, found, is_primary).

    Eligible: every site was found, no two overlap and one is primary. What may survive is never the primary: the strongest, then
    earliest, of the strong ones, and the earliest weak one.
    """
    before = F.lag("end").over(Window.partitionBy(fact).orderBy("start", "end"))
    rank = F.array_position(F.array(*map(F.lit, strong)), F.col("strength"))
    other = ~F.col("is_primary")
    marked = sites.withColumn("_overlaps", F.coalesce(before > F.col("start"), F.lit(False))).withColumn("_rank", rank)
    per = marked.groupBy(fact).agg(
        F.count(F.lit(1)).alias("n_sites"), (F.bool_and("found") & ~F.bool_or("_overlaps") & F.bool_or("is_primary")).alias("eligible"),
        F.min(F.when(other & (F.col("_rank") > 0), F.struct("_rank", "start", "site"))).alias("_s"), F.min(F.when(other & (F.col("strength") == weak), F.struct("start", "site"))).alias("_w"),
    )
    return per.select(fact, "n_sites", "eligible", *(F.when(F.col("eligible"), F.col(f"{a}.site")).alias(n) for a, n in (("_s", "strong_site"), ("_w", "weak_site"))))


def folded(first: DataFrame, later: DataFrame, keys: list[str], value: str) -> DataFrame:
    """first with nulls of ``value`` filled from a completion pass, and where the value is from: first, completed or open."""
    both = first.join(later.select(*keys, F.col(value).alias("_later")), keys, "left")
    origin = F.when(F.col(value).isNotNull(), "first").when(F.col("_later").isNotNull(), "completed").otherwise("open")
    return both.withColumns({"origin": origin, value: F.coalesce(value, "_later")}).drop("_later")


def harvested(known: DataFrame, round_: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each key of a later round that is not known yet."""
    fresh = round_.join(known.select(*keys).distinct(), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min(order).alias(order))


def reviewed_hits(df: DataFrame, key: str, text: str, pattern: str, cleared: DataFrame) -> DataFrame:
    """(key, hits, reviewed): rows whose text has the pattern, and whether the list of cleared rows has them."""
    hits = df.select(key, F.regexp_count(text, F.lit(pattern)).alias("hits")).where("hits > 0")
    return hits.join(cleared.select(key, F.lit(True).alias("_ok")).distinct(), key, "left").select(key, "hits", F.coalesce("_ok", F.lit(False)).alias("reviewed"))


def must_be_reviewed(hits: DataFrame, key: str) -> DataFrame:
    """The hits, if all are reviewed; otherwise an error that names some that are not."""
    open_ = [str(r[key]) for r in hits.where("not reviewed").select(key).limit(10).collect()]
    if open_:
        raise ValueError(f"hits that nobody reviewed: {', '.join(open_)}")
    return hits
