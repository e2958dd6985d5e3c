"""Queries of screening, progress, health and cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import screening as S
from citeloom.plans.views import duck, view
from citeloom.registry import query

_KEPT = "dedup = '保留'"
_SOUGHT = f"{_KEPT} AND ta_screen = '进入全文'"
_COUNTS = f"""{duck('v_ledger')}, c AS MATERIALIZED (SELECT count(*) AS identified, count(*) FILTER (starts_with(dedup, '重复')) AS duplicates_removed, count(*) FILTER ({_KEPT}) AS after_dedup,
    count(*) FILTER ({_KEPT} AND ta_screen = '排除') AS ta_excluded, count(*) FILTER ({_SOUGHT}) AS sought, count(*) FILTER ({_SOUGHT} AND ft_screen = '全文不可得') AS not_retrieved,
    count(*) FILTER ({_SOUGHT} AND ft_screen = '排除') AS ft_excluded, count(*) FILTER ({_SOUGHT} AND ft_screen = '纳入') AS included FROM v_ledger)"""
_LAWS = "SELECT 'dedup' AS law, identified - (duplicates_removed + after_dedup) AS difference FROM c UNION ALL SELECT 'screen', after_dedup - (ta_excluded + sought) FROM c UNION ALL SELECT 'full_text', sought - (not_retrieved + ft_excluded + included) FROM c"
_PENDING = f"SELECT seq FROM v_ledger WHERE {_KEPT} AND (ta_screen IN ('', '待定') OR (ta_screen = '进入全文' AND ft_screen IN ('', '待定')))"
_CONFLICTS = """SELECT seq, 'duplicate_screened' AS rule FROM v_ledger WHERE starts_with(dedup, '重复') AND (ta_screen <> '' OR ft_screen <> '')
    UNION ALL SELECT seq, 'excluded_with_full_text' FROM v_ledger WHERE ta_screen IN ('排除', '待定') AND ft_screen <> ''
    UNION ALL SELECT seq, 'excluded_without_code' FROM v_ledger WHERE ft_screen = '排除' AND exclude_code = ''"""


def _put(name, sql, f):
    @query(name, sql)
    def run(spark, sf_dir):
        return f(view(spark, sf_dir, "v_ledger"))


_put("prisma_counts", f"{_COUNTS} SELECT *, sought - not_retrieved AS ft_assessed FROM c", S.stage_counts)
_put("prisma_reasons", f"{duck('v_ledger')} SELECT exclude_code, count(*) AS n FROM v_ledger WHERE {_SOUGHT} AND ft_screen = '排除' AND exclude_code <> '' GROUP BY 1", S.exclusion_reasons)
_put("prisma_conservation", f"{_COUNTS} {_LAWS}", lambda v: S.conservation(S.stage_counts(v)))
_put("ledger_conflicts", f"{duck('v_ledger')} {_CONFLICTS}", S.conflicts)
_put("ledger_pending", f"{duck('v_ledger')} {_PENDING}", S.pending)
_put("screen_gate", f"""{_COUNTS}, l AS ({_LAWS}), p AS ({_PENDING}), x AS ({_CONFLICTS}) SELECT (CASE WHEN (SELECT identified FROM c) = 0 OR (SELECT count(*) FROM p) > 0 THEN 2
    WHEN (SELECT count(*) FROM l WHERE difference <> 0) + (SELECT count(*) FROM x) > 0 THEN 1 ELSE 0 END)::INT AS exit_code""", S.gate)  # fmt: skip

_COMMANDS = [("find", "search", "released"), ("read", "search", "released"), ("import", "search", "released"), ("check", "write", "released"), ("draft", "write", "released"), ("style", "polish", "released"), ("anchor", "polish", "planned")]


_CMD = f"cmd(command, phase, status) AS (VALUES {', '.join(str(c) for c in _COMMANDS)})"


@query("stage_progress", f"""{duck('v_trace')}, {_CMD}, u AS (SELECT command, count(*) AS n, max(day) AS d FROM v_trace GROUP BY command),
    g AS (SELECT phase, count(*) FILTER (status = 'released') AS released, count(n) AS used, coalesce(sum(n), 0)::BIGINT AS entries, max(d)::VARCHAR AS last_day,
          coalesce(string_agg(command, ',' ORDER BY command) FILTER (n IS NOT NULL), '') AS done, coalesce(string_agg(command, ',' ORDER BY command) FILTER (n IS NULL AND status = 'released'), '') AS "left" FROM cmd LEFT JOIN u USING (command) GROUP BY phase)
    SELECT *, CASE WHEN released = 0 THEN 'none' WHEN used = 0 THEN 'red' WHEN used / released >= 2 / 3 THEN 'green' ELSE 'yellow' END AS badge FROM g""")  # fmt: skip
def stage_progress(spark, sf_dir):
    """Commands run in each phase."""
    return S.stage_progress(view(spark, sf_dir, "v_trace"), spark.createDataFrame(_COMMANDS, "command string, phase string, status string"))


@query("progress_totals", f"""{duck('v_trace')}, {_CMD} SELECT count(*) AS entries, count(*) FILTER (phase IS NULL) AS unknown, count(DISTINCT phase) AS covered_phases FROM v_trace LEFT JOIN cmd USING (command)""")
def progress_totals(spark, sf_dir):
    """Entries in all, and phases with one."""
    return S.progress_totals(view(spark, sf_dir, "v_trace"), spark.createDataFrame(_COMMANDS, "command string, phase string, status string"))


@query("disclosure_levels", """WITH l(level, position) AS (VALUES ('none', 0), ('click', 1), ('view', 2), ('large', 3)),
    e AS (SELECT event_type AS level FROM events UNION ALL SELECT 'large' FROM events WHERE value > 200) SELECT l.level, l.position::INT AS position, count(e.level) AS entries FROM l LEFT JOIN e USING (level) GROUP BY ALL""")  # fmt: skip
def disclosure_levels(spark, sf_dir):
    """Events under each of their levels; levels without any are listed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    levels = F.array_compact(F.array(F.col("event_type"), F.when(F.col("value") > 200, "large")))
    return S.disclosed(e.select(F.col("event_id").alias("entry_id"), levels.alias("levels")), ["none", "click", "view", "large"])


@query("recent_window", f"{duck('v_trace')} SELECT event_id, command FROM v_trace WHERE day BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'")
def recent_window(spark, sf_dir):
    """The seven days up to a given one."""
    return S.recent(view(spark, sf_dir, "v_trace"), "2024-01-20", 7).select("event_id", "command")


@query("cache_ttl_latest", """WITH c AS (SELECT event_type AS source, user_id::VARCHAR AS key, props AS payload, date_trunc('second', ts) AS seen FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY seen DESC, payload DESC) AS rn FROM c)
    SELECT source, key, payload FROM l WHERE rn = 1 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(seen) <= 7 * 86400""")  # fmt: skip
def cache_ttl_latest(spark, sf_dir):
    """Answers that still hold."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cache = e.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.date_trunc("second", "ts").alias("fetched_at"))
    return S.cache_latest(cache, "2024-01-31 00:00:00").select("source", "key", "payload")


_PROBES = "SELECT CASE user_id % 7 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' WHEN 2 THEN 'semantic_scholar' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'pubmed' ELSE 'eric' END AS source, event_type, value FROM {}"


@query("source_states", f"""WITH e AS ({_PROBES.format('events')}), a AS (SELECT source, bool_and(event_type = 'error') AS failed FROM e GROUP BY source)
    SELECT source, CASE WHEN source IN ('pubmed', 'eric') THEN 'supplementary' ELSE 'core' END AS role, CASE WHEN failed THEN 'unavailable' WHEN source = 'semantic_scholar' THEN 'partial' ELSE 'ok' END AS status FROM a""")  # fmt: skip
def source_states(spark, sf_dir):
    """The state of each source by its probes: away if all of them failed."""
    return S.probe_states(_probes(spark, sf_dir))


def _probes(spark, sf_dir):
    e = spark.sql(_PROBES.format("{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    failed = F.bool_and(F.col("event_type") == "error")
    role = F.when(F.col("source").isin("pubmed", "eric"), "supplementary").otherwise("core")
    return e.groupBy("source").agg(F.when(failed, "TIMEOUT").alias("error")).select("source", role.alias("role"), "error")


@query("health_rollup", f"""WITH e AS ({_PROBES.format('events')}), a AS (SELECT source, source NOT IN ('pubmed', 'eric') AS core, bool_and(event_type = 'error') AS failed FROM e GROUP BY source),
    o AS (SELECT CASE WHEN count(*) FILTER (core AND failed) = count(*) FILTER (core) THEN 'offline' WHEN count(*) FILTER (core AND (failed OR source = 'semantic_scholar')) = 0 THEN 'ok' ELSE 'degraded' END AS o, coalesce(bool_or(NOT core AND failed), false) AS hurt FROM a)
    SELECT CASE WHEN (SELECT count(*) FROM nation) = 0 THEN 'blocked' WHEN o = 'offline' THEN 'offline' WHEN o = 'degraded' OR hurt THEN 'degraded' ELSE 'ok' END AS overall, CASE WHEN o = 'offline' THEN 'offline' ELSE 'ok' END AS network FROM o""")  # fmt: skip
def health_rollup(spark, sf_dir):
    """Health by the probes, and by one runtime fact: there are nations."""
    facts = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.when(F.count(F.lit(1)) > 0, "ok").otherwise("fail").alias("status")).select(F.lit("tables").alias("check"), "status", F.lit("runtime").alias("grp"))
    return S.overall_health(facts, S.probe_states(_probes(spark, sf_dir)))


@query("cache_put", """WITH c AS (SELECT event_type AS source, user_id::VARCHAR AS key, props AS payload, date_trunc('second', ts) AS seen FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY seen DESC, payload DESC) AS rn FROM c) SELECT source, key, payload FROM l WHERE rn = 1""")  # fmt: skip
def cache_put(spark, sf_dir):
    """A cache of low values, into which the others are put."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.date_trunc("second", "ts").alias("fetched_at"), "value")
    return S.cache_put(rows.filter("value < 100").drop("value"), rows.filter("value >= 100").drop("value")).select("source", "key", "payload")
