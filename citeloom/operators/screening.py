"""Screening ledgers, audit trails, health facts and the answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT, OUT, ON, IN, GONE, OPEN = "保留", "排除", "进入全文", "纳入", "全文不可得", ("", "待定")


def _flags() -> dict[str, Column]:
    kept = F.col("dedup") == KEPT
    sought = kept & (F.col("ta_screen") == ON)
    ft = F.col("ft_screen")
    return {
        "identified": F.lit(True), "duplicates_removed": F.col("dedup").startswith("重复"), "after_dedup": kept,
        "ta_excluded": kept & (F.col("ta_screen") == OUT), "sought": sought, "not_retrieved": sought & (ft == GONE),
        "ft_excluded": sought & (ft == OUT), "included": sought & (ft == IN),
    }


def stage_counts(ledger: DataFrame) -> DataFrame:
    """PRISMA counts in one pass; a misspelt value falls in no stage, so the identities show it."""
    c = ledger.agg(*[F.count_if(f).alias(n) for n, f in _flags().items()])
    return c.withColumn("ft_assessed", F.col("sought") - F.col("not_retrieved"))


def exclusion_reasons(ledger: DataFrame) -> DataFrame:
    rows = ledger.filter(_flags()["ft_excluded"] & (F.col("exclude_code") != ""))
    return rows.groupBy("exclude_code").agg(F.count(F.lit(1)).alias("n"))


def conservation(counts: DataFrame) -> DataFrame:
    """The three identities of the flow and by how much each is off."""
    laws = {"dedup": "identified - (duplicates_removed + after_dedup)", "screen": "after_dedup - (ta_excluded + sought)", "full_text": "sought - (not_retrieved + ft_excluded + included)"}
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("law"), F.expr(e).alias("difference")) for k, e in laws.items()])))


def conflicts(ledger: DataFrame) -> DataFrame:
    """Rows whose cells contradict each other: one row for each rule broken."""
    empty = lambda c: F.col(c) == ""
    rules = {
        "duplicate_screened": F.col("dedup").startswith("重复") & (~empty("ta_screen") | ~empty("ft_screen")),
        "excluded_with_full_text": F.col("ta_screen").isin(OUT, "待定") & ~empty("ft_screen"),
        "excluded_without_code": (F.col("ft_screen") == OUT) & empty("exclude_code"),
    }
    broken = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return ledger.select("seq", F.explode(broken).alias("rule"))


def pending(ledger: DataFrame) -> DataFrame:
    """Kept rows that no one has finished."""
    open_ft = (F.col("ta_screen") == ON) & F.col("ft_screen").isin(*OPEN)
    return ledger.filter((F.col("dedup") == KEPT) & (F.col("ta_screen").isin(*OPEN) | open_ft)).select("seq")


def gate(ledger: DataFrame) -> DataFrame:
    """What stops the flow picture: malformed rows (1), nothing or unfinished rows (2), broken laws
    or rows (1), or nothing (0). One pass: every rule is a count."""
    f = _flags()
    empty = lambda c: F.col(c) == ""
    open_ft = (F.col("ta_screen") == ON) & F.col("ft_screen").isin(*OPEN)
    broken = (F.col("dedup").startswith("重复") & (~empty("ta_screen") | ~empty("ft_screen"))) | (F.col("ta_screen").isin(OUT, "待定") & ~empty("ft_screen")) | ((F.col("ft_screen") == OUT) & empty("exclude_code"))
    malformed = F.col("malformed") if "malformed" in ledger.columns else F.lit(False)
    c = ledger.agg(
        *[F.count_if(x & ~malformed).alias(n) for n, x in f.items()], F.count_if(malformed).alias("_malformed"), F.count_if(broken & ~malformed).alias("_broken"),
        F.count_if(~malformed & (F.col("dedup") == KEPT) & (F.col("ta_screen").isin(*OPEN) | open_ft)).alias("_open"),
    )
    off = F.expr("identified <> duplicates_removed + after_dedup OR after_dedup <> ta_excluded + sought OR sought <> not_retrieved + ft_excluded + included")
    code = F.when(F.col("_malformed") > 0, 1).when((F.col("identified") == 0) | (F.col("_open") > 0), 2).when(off | (F.col("_broken") > 0), 1).otherwise(0)
    return c.select(code.alias("exit_code"))


def stage_progress(trace: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands run in each phase against those released there; unknown commands count in no
    phase. `commands` has command, phase, status and, if not all count, tracked."""
    counted = commands.filter("tracked") if "tracked" in commands.columns else commands
    used = trace.groupBy("command").agg(F.count(F.lit(1)).alias("entries"), F.max("day").alias("last_day"))
    j = counted.join(used, "command", "left")
    done, released = F.col("entries").isNotNull(), F.col("status") == "released"
    names = lambda where: F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("command")))), ",")
    g = j.groupBy("phase").agg(
        F.count_if(released).alias("released"), F.count_if(done).alias("used"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.max("last_day").cast("string").alias("last_day"),
        names(done).alias("done"), names(released & ~done).alias("left"),
    )
    share = F.col("used") / F.col("released")
    colour = F.when(F.col("released") == 0, "none").when(F.col("used") == 0, "red").when(share >= 2 / 3, "green").otherwise("yellow")
    return g.withColumn("badge", colour)


def progress_totals(trace: DataFrame, commands: DataFrame) -> DataFrame:
    """Entries in all, of unknown commands too, and research phases with at least one."""
    j = trace.join(F.broadcast(commands.select("command", "phase")), "command", "left")  # a row for each command there is
    phases = F.count_distinct(F.when(F.col("phase") != "infra", F.col("phase")))
    return j.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("phase").isNull()).alias("unknown"), phases.alias("covered_phases"))


CORE = ("crossref", "openalex", "semantic_scholar", "arxiv")


def probe_states(answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(source, role, status) by one answer of each source (source, role, error): reachable if it
    answered, also "not found"; Semantic Scholar without a key is only partly so."""
    slow = (F.col("source") == "semantic_scholar") & F.lit("semantic_scholar" not in (keys or []))
    return answers.select("source", "role", F.when(F.col("error").isNotNull(), "unavailable").when(slow, "partial").otherwise("ok").alias("status"))


def sources_overall(states: DataFrame) -> DataFrame:
    """Over the core sources: offline if none is there or answers, ok if all do, else degraded."""
    core = F.col("source").isin(*CORE)
    s = states.agg(F.count_if(core).alias("n"), F.count_if(core & (F.col("status") == "ok")).alias("ok"), F.count_if(core & (F.col("status") == "unavailable")).alias("away"))
    return s.select(F.when(F.col("away") == F.col("n"), "offline").when(F.col("ok") == F.col("n"), "ok").otherwise("degraded").alias("overall"))


def overall_health(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Blocked by a failed runtime fact (check, status), else offline or degraded by the sources
    (a supplementary one that is away degrades too), else ok; and the network they tell of.
    Facts of other groups (credentials, cache, typesetting) never count."""
    runtime = facts.filter("grp = 'runtime'") if "grp" in facts.columns else facts
    blocked = runtime.agg(F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False)).alias("blocked"), F.lit(1).alias("_k"))
    extra = states.agg(F.coalesce(F.bool_or((F.col("role") == "supplementary") & (F.col("status") == "unavailable")), F.lit(False)).alias("hurt"), F.lit(1).alias("_k"))
    j = blocked.join(extra, "_k").join(sources_overall(states).withColumn("_k", F.lit(1)), "_k")  # a row each
    overall = F.when(F.col("blocked"), "blocked").when(F.col("overall") == "offline", "offline").when((F.col("overall") == "degraded") | F.col("hurt"), "degraded").otherwise("ok")
    return j.select(overall.alias("overall"), F.when(F.col("overall") == "offline", "offline").otherwise("ok").alias("network"))


def disclosed(trace: DataFrame, levels: list[str]) -> DataFrame:
    """Entries of an audit trail (entry_id, levels) under each level of help, of which an entry
    may have several; levels without entries are listed too."""
    known = trace.sparkSession.createDataFrame([(n, i) for i, n in enumerate(levels)], "level string, position int")
    used = trace.select("entry_id", F.explode(F.array_distinct("levels")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("entries"))
    return F.broadcast(known).join(used, "level", "left").select("level", "position", F.coalesce("entries", F.lit(0)).alias("entries"))


def cache_put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with answers put in: the later of a key stays."""
    both = cache.unionByName(answers.select(*cache.columns))
    held = [c for c in both.columns if c not in ("source", "key")]
    return both.groupBy("source", "key").agg(F.max_by(F.struct(*held), F.struct("fetched_at", "payload")).alias("r")).select("source", "key", "r.*")


def cache_latest(cache: DataFrame, now: str, ttl_days: int | dict[str, int] = 7) -> DataFrame:
    """The latest answer of each key that still holds at `now`; an aggregate, combined before the
    shuffle. Days may be given by source; others hold for 7."""
    held = [c for c in cache.columns if c not in ("source", "key")]
    latest = cache.groupBy("source", "key").agg(F.max_by(F.struct(*held), F.struct("fetched_at", "payload")).alias("r")).select("source", "key", "r.*")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")
    days = F.lit(ttl_days) if isinstance(ttl_days, int) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ttl_days.items() for x in kv]), F.col("source")), F.lit(7))
    return latest.filter(age <= days * 86400)


def recent(rows: DataFrame, today: str, days: int, column: str = "day") -> DataFrame:
    """The last `days` days, today among them."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    return rows.filter(F.col(column).between(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date")))
