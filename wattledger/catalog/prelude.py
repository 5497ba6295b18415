"""The contract views as SQL, for the DuckDB side of each check.

DuckDB's ``epoch_ms`` rounds microseconds; integer division floors them as Spark does.
"""

from __future__ import annotations

_FMT = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(CAST(({ms}) * 1000 AS BIGINT)), {_FMT})"


VIEWS = {
    "ev": f"""
  SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 16, '0') AS event_id,
         'u' || CAST(user_id AS VARCHAR) AS session_id,
         event_id AS arrival, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) // 1000 AS ts_ms,
         epoch_us(ts) // 1000 + CAST(round(value * 100) AS BIGINT) * 6000 AS end_ms
  FROM events""",
    "spans": """
  SELECT event_id, session_id, arrival * 2 AS arrival, k, ts_ms,
         CASE WHEN k % 10 = 1 THEN session_id || '-shared' ELSE 's' || CAST(arrival AS VARCHAR) END AS span_id,
         ['Bash','Edit','WebFetch','mcp__db','Task','Read','Planner'][k % 7 + 1] AS tool_name,
         ['bash','file_op','web','mcp','subagent','file_op','other'][k % 7 + 1] AS tool_kind,
         ['local','hybrid','unknown','remote'][k % 4 + 1] AS locus,
         ts_ms AS s, end_ms AS e,
         CASE WHEN k % 3 = 0 THEN CAST([] AS BIGINT[]) ELSE [k % 5] END AS pids,
         ['ok','error','cancelled','unknown'][k % 4 + 1] AS status,
         't' || CAST(k % 7 AS VARCHAR) AS task_id,
         CASE WHEN k % 5 <> 4 THEN 'c' || CAST(k % 11 AS VARCHAR) END AS tool_call_id
  FROM ev WHERE event_type = 'click'
  UNION ALL
  SELECT 'boot-' || event_id, session_id, arrival * 2 + 1, k, ts_ms, 'session-boot-' || session_id,
         '__session__', 'other', 'local', ts_ms, ts_ms, CAST([0, 1] AS BIGINT[]), 'ok', NULL, NULL
  FROM ev WHERE event_type = 'signup'""",
    "att": "SELECT * FROM spans WHERE e > s AND locus <> 'remote'",
    "roots": "SELECT DISTINCT session_id, unnest(pids) AS pid FROM spans WHERE tool_name = '__session__'",
    "samples": """
  SELECT event_id AS sample_id, session_id, k, ts_ms, ts_ms AS t0, end_ms AS t1, value * 10 AS energy_j, value
  FROM ev WHERE event_type = 'purchase'""",
    "wins": """
  SELECT event_id AS window_id, session_id, k, ts_ms, ts_ms AS w0, end_ms AS w1, arrival
  FROM ev WHERE event_type = 'error'""",
    "procs": """
  SELECT window_id, session_id, w0, w1, k % 5 AS pid, k * 600000 AS cpu,
         CASE WHEN k % 10 = 0 THEN 's' || CAST(arrival AS VARCHAR) END AS orphan_of, k * 4096 AS rss, 0 AS pos, k
  FROM wins WHERE k % 13 <> 0
  UNION ALL
  SELECT window_id, session_id, w0, w1, (k + 1) % 5, k * 300000, NULL, k * 4096, 1, k FROM wins WHERE k % 13 <> 0""",
    "calls": """
  SELECT event_id, session_id, arrival * 2 AS arrival, k, ts_ms,
         'p' || CAST(k % 2 AS VARCHAR) AS provider, 'm' || CAST(k % 6 AS VARCHAR) AS model_requested,
         CASE WHEN k % 2 = 0 THEN 'm' || CAST(k % 6 AS VARCHAR) END AS model_served,
         k * 100 AS input_tokens, CASE WHEN k % 17 <> 0 THEN k * 10 END AS output_tokens,
         CASE WHEN k % 5 = 0 THEN k END AS thought_tokens, CASE WHEN k % 3 = 0 THEN k * 50 END AS cached_read_tokens,
         CAST(NULL AS BIGINT) AS cached_write_tokens,
         CASE WHEN k % 4 <> 0 THEN k * 20 END AS duration_ms,
         ['api_response','agent_telemetry','transcript','estimated'][k % 4 + 1] AS usage_source,
         ['ok','error','cancelled','unknown'][k % 4 + 1] AS status,
         ['cc-hooks','otlp-codex','otlp-genai','codecarbon'][k % 4 + 1] AS collector,
         't' || CAST(k % 7 AS VARCHAR) AS task_id,
         CASE WHEN k % 5 <> 4 THEN 'c' || CAST(k % 11 AS VARCHAR) END AS tool_call_id
  FROM ev WHERE event_type = 'view'""",
    "ests": """
  SELECT event_id, session_id, k, CASE WHEN k % 7 = 0 THEN 'unknown_model' WHEN k % 23 <> 0 THEN 'ok' END AS status,
         'factors-' || CAST(k % 2 AS VARCHAR) AS methodology_version,
         CASE WHEN k % 8 <> 5 THEN ['FRA','DEU','WOR'][k % 3 + 1] END AS region_id,
         (k % 7 <> 0 AND k % 23 <> 0 AND k % 29 <> 0) AS has_impacts
  FROM ev WHERE event_type = 'view' AND k % 9 <> 0""",
    "crit": """
  SELECT e.event_id, e.session_id, c.ts_ms, c.criterion, c.unit, c.lo, c.hi
  FROM ests e JOIN (
    SELECT event_id, ts_ms, 'energy' AS criterion, CASE WHEN k = 50 THEN 'Wh' ELSE 'kWh' END AS unit, k * 1e-4 AS lo, k * 2e-4 AS hi FROM calls
    UNION ALL SELECT event_id, ts_ms, 'gwp', 'kgCO2eq', k * 1e-3, k * 3e-3 FROM calls WHERE k % 20 <> 19
    UNION ALL SELECT event_id, ts_ms, 'adpe', 'kgSbeq', k * 1e-7, k * 2e-7 FROM calls
    UNION ALL SELECT event_id, ts_ms, 'pe', 'MJ', k * 1e-2, k * 2e-2 FROM calls
    UNION ALL SELECT event_id, ts_ms, 'water', 'L', k * 1e-3, k * 2e-3 FROM calls) c USING (event_id)
  WHERE e.has_impacts""",
    "facts": """
  SELECT CASE WHEN part = 1 THEN 'boot-' || event_id ELSE event_id END AS event_id, session_id, ts_ms, k,
         CASE WHEN part = 1 THEN 'action_span' ELSE
           CASE event_type WHEN 'click' THEN 'action_span' WHEN 'view' THEN 'llm_call' WHEN 'purchase' THEN 'energy_sample'
                WHEN 'error' THEN 'process_sample' ELSE 'session_meta' END END AS type,
         ['cc-hooks','otlp-codex','otlp-genai','codecarbon'][k % 4 + 1] AS collector, arrival * 2 + part AS arrival, part
  FROM ev JOIN (SELECT 0 AS part UNION ALL SELECT 1) ON part = 0 OR event_type = 'signup'""",
    # Apportionment, written as plain theta joins.
    "cover": """
  SELECT s.sample_id, s.session_id, s.t0, s.t1, w.window_id, w.w0, w.w1, w.k,
         (least(w.w1, s.t1) - greatest(w.w0, s.t0)) / CAST(w.w1 - w.w0 AS DOUBLE) AS fraction
  FROM samples s JOIN wins w ON w.session_id = s.session_id AND w.w0 < s.t1 AND w.w1 > s.t0 AND w.w1 > w.w0 AND s.t1 > s.t0""",
    "active": """
  SELECT s.sample_id, s.session_id, a.event_id, a.span_id, a.tool_name, a.locus, a.pids,
         least(a.e, s.t1) - greatest(a.s, s.t0) AS overlap_ms
  FROM samples s JOIN att a ON a.session_id = s.session_id AND a.s < s.t1 AND a.e > s.t0 AND s.t1 > s.t0""",
    "ppid": """
  SELECT c.sample_id, c.session_id, c.window_id, p.pid, max(p.cpu) * any_value(c.fraction) AS cpu_ms,
         bool_or(p.orphan_of IS NOT NULL) AS tagged
  FROM cover c JOIN procs p ON p.window_id = c.window_id GROUP BY 1, 2, 3, 4""",
    "claims": """
  SELECT a.sample_id, a.event_id, a.span_id, p.pid
  FROM active a JOIN (SELECT DISTINCT sample_id, session_id, pid FROM ppid) p ON p.sample_id = a.sample_id
  WHERE list_contains(a.pids, p.pid)
     OR (len(a.pids) = 0 AND EXISTS (SELECT 1 FROM roots r WHERE r.session_id = p.session_id AND r.pid = p.pid))""",
    "shares": """
  SELECT p.*, coalesce(n.n, 0) AS n, p.tagged OR n.n IS NULL AS to_orphan,
         p.cpu_ms / (coalesce(n.n, 0) + CASE WHEN p.tagged OR n.n IS NULL THEN 1 ELSE 0 END) AS share
  FROM ppid p LEFT JOIN (SELECT sample_id, pid, count(*) AS n FROM claims GROUP BY 1, 2) n USING (sample_id, pid)""",
    "wts": """
  SELECT sample_id, sum(share * (n + CASE WHEN to_orphan THEN 1 ELSE 0 END)) AS total_w,
         coalesce(sum(share) FILTER (to_orphan), 0) AS orphan_w,
         coalesce(sum(cpu_ms) FILTER (EXISTS (SELECT 1 FROM roots r WHERE r.session_id = shares.session_id AND r.pid = shares.pid)), 0) AS root_cpu_ms
  FROM shares GROUP BY 1""",
    "head": """
  SELECT s.sample_id, s.session_id, s.ts_ms, s.t0, s.t1, s.energy_j, coalesce(a.n_active, 0) AS n_active, coalesce(a.ov, 0) AS ov,
         c.sample_id IS NOT NULL AS covered, coalesce(w.total_w, 0) AS total_w, coalesce(w.orphan_w, 0) AS orphan_w,
         coalesce(w.root_cpu_ms, 0) AS root_cpu_ms, c.sample_id IS NOT NULL AND w.sample_id IS NULL AS unobserved,
         CASE WHEN c.sample_id IS NOT NULL AND NOT (coalesce(a.n_active, 0) = 0 AND coalesce(w.orphan_w, 0) <= 0) THEN 'l2_cpu_time/v1'
              WHEN c.sample_id IS NULL AND coalesce(a.n_active, 0) > 0 THEN 'l1_wall_clock/v1' ELSE 'none' END AS policy_id
  FROM samples s
  LEFT JOIN (SELECT sample_id, count(*) AS n_active, sum(overlap_ms) AS ov FROM active GROUP BY 1) a USING (sample_id)
  LEFT JOIN (SELECT DISTINCT sample_id FROM cover) c ON c.sample_id = s.sample_id
  LEFT JOIN wts w ON w.sample_id = s.sample_id""",
    "rates": """
  SELECT *, CASE WHEN policy_id = 'l2_cpu_time/v1' AND total_w > 0 THEN energy_j * least(1.0, total_w / (t1 - t0)) / total_w ELSE 0 END AS jcpu,
         CASE WHEN policy_id = 'l1_wall_clock/v1' THEN energy_j / (t1 - t0) / greatest(1.0, ov / CAST(t1 - t0 AS DOUBLE)) ELSE 0 END AS jwall
  FROM head""",
    "paid": """
  SELECT a.sample_id, a.session_id, a.event_id, a.span_id, a.tool_name, a.locus, a.overlap_ms, r.policy_id,
         CASE WHEN r.policy_id = 'l2_cpu_time/v1' THEN coalesce(w.w, 0) ELSE 0 END AS w,
         CASE WHEN r.policy_id = 'l2_cpu_time/v1' THEN coalesce(w.w, 0) * r.jcpu ELSE a.overlap_ms * r.jwall END AS j,
         r.energy_j * a.overlap_ms / (r.t1 - r.t0) AS l1_j
  FROM active a JOIN rates r ON r.sample_id = a.sample_id AND r.policy_id <> 'none'
  LEFT JOIN (SELECT c.sample_id, c.event_id, sum(s.share) AS w FROM claims c
             JOIN shares s ON s.sample_id = c.sample_id AND s.pid = c.pid GROUP BY 1, 2) w
    ON w.sample_id = a.sample_id AND w.event_id = a.event_id""",
    "split": """
  SELECT r.sample_id, r.session_id, r.ts_ms, r.t0, r.t1, r.energy_j, r.policy_id, coalesce(p.j, 0) AS attributed_j,
         r.orphan_w * r.jcpu AS orphaned_j, r.energy_j - coalesce(p.j, 0) - r.orphan_w * r.jcpu AS baseline_j,
         CASE WHEN r.policy_id <> 'none' THEN r.ov / CAST(r.t1 - r.t0 AS DOUBLE) ELSE 0 END AS shadow, r.root_cpu_ms, r.unobserved
  FROM rates r LEFT JOIN (SELECT sample_id, sum(j) AS j FROM paid GROUP BY 1) p USING (sample_id)""",
}

_NEEDS: dict[str, list[str]] = {}


def _refs(text: str) -> list[str]:
    import re

    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text)) | set(re.findall(r",\s*([a-z]+)\s+(?:WHERE|ON)\b", text))
    return [v for v in VIEWS if v in words]


def with_views(sql: str, **extra: str) -> str:
    """Prefix a statement with the views it uses, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _refs(text):
            if name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    for text in extra.values():
        visit(text)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    ctes += [f"{name} AS ({text})" for name, text in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
