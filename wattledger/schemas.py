"""Fixed contract: record schemas, enumerations, constants and lookup tables."""

from __future__ import annotations

# Fixed values of the contract: enumerations.
EVENT_TYPES = ("llm_call", "energy_sample", "action_span", "process_sample", "session_meta")
USAGE_SOURCES = ("api_response", "agent_telemetry", "transcript", "estimated")
STATUSES = ("ok", "error", "cancelled", "unknown")
ENERGY_KINDS = ("cpu", "dram", "gpu", "total", "other")
ENERGY_METHODS = ("rapl", "powermetrics", "nvml", "tdp_model", "other")
TOOL_KINDS = ("bash", "mcp", "file_op", "subagent", "web", "other")
LOCI = ("local", "remote", "hybrid", "unknown")
POWER_SOURCES = ("ac", "battery", "unknown")
CRITERIA = ("adpe", "energy", "gwp", "pe", "water")
ESTIMATE_STATUSES = ("ok", "pending", "unknown_model", "missing_zone", "error")

# Fixed values of the contract: constants.
SCHEMA_VERSION = "0.1.0"
VERSION_PATTERN = r"^0\.1\.[0-9]+$"
MIN_EVENT_ID_LEN = 16
BOOTSTRAP_TOOL = "__session__"
J_PER_KWH = 3.6e6
DAY_MS = 86_400_000
REJECT_RING = 1_000
REJECT_WINDOW = 100
MAX_LOG_RECORDS = 10_000
MAX_ATTR_VALUE_BYTES = 64 * 1024
MAX_ATTR_KEY_BYTES = 256
MAX_REJECT_KEYS = 64
MAX_READ_BYTES = 8 * 1024 * 1024
REJECT_SAMPLE_BYTES = 256
ORPHAN_TAIL_MS = 60_000
IDLE_SESSION_MS = 600_000
POLICY_L1 = "l1_wall_clock/v1"
POLICY_L2 = "l2_cpu_time/v1"
POLICY_NONE = "none"
DEFAULT_ZONE = "WOR"

# Fixed values of the contract: which agent a collector belongs to.
COLLECTOR_AGENTS = {
    "claude-code": "claude-code",
    "cc-hooks": "claude-code",
    "otlp-cc": "claude-code",
    "codex": "codex",
    "opencode": "opencode",
}
CODEX_COLLECTOR_PREFIX = "otlp-codex"
AGENT_NAMES = {"claude-code": "Claude Code", "codex": "Codex", "opencode": "OpenCode"}

# Fixed values of the contract: meter mode -> energy method.
METER_METHODS = {
    "cpu_load": "tdp_model",
    "constant": "tdp_model",
    "rapl": "rapl",
    "powermetrics": "powermetrics",
    "nvml": "nvml",
}

# Record schemas (DDL).
ATTRIBUTION = "struct<agent_id:string,subagent_id:string,task_id:string,tool_call_id:string>"
COLLECTOR = "struct<name:string,version:string>"
USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,thought_tokens:bigint,"
    "cached_read_tokens:bigint,cached_write_tokens:bigint>"
)
LLM_CALL = (
    "struct<provider:string,model_id_requested:string,model_id_served:string,endpoint:string,"
    f"usage:{USAGE},usage_source:string,duration_ms:bigint,status:string,streaming:boolean>"
)
COMPONENT = "struct<kind:string,label:string,energy_j:double,method:string>"
ENERGY_SAMPLE = f"struct<t_start:string,t_end:string,components:array<{COMPONENT}>,host_id:string>"
ACTION_SPAN = (
    "struct<span_id:string,tool_name:string,tool_kind:string,execution_locus:string,"
    "t_start:string,t_end:string,pids:array<bigint>,cgroup:string,status:string>"
)
PROCESS = (
    "struct<pid:bigint,cpu_time_delta_ms:bigint,orphan_of:string,"
    "memory_rss_bytes:bigint,io_read_bytes:bigint,io_write_bytes:bigint>"
)
PROCESS_SAMPLE = f"struct<t_start:string,t_end:string,processes:array<{PROCESS}>>"
SESSION_META = (
    "struct<agent_app:struct<name:string,version:string>,os:string,"
    "hardware:struct<cpu_model:string,gpu_models:array<string>,ram_gb:double>,"
    "geo_zone:string,power_source:string>"
)
PAYLOADS = {
    "llm_call": LLM_CALL,
    "energy_sample": ENERGY_SAMPLE,
    "action_span": ACTION_SPAN,
    "process_sample": PROCESS_SAMPLE,
    "session_meta": SESSION_META,
}
HEADER = (
    f"schema_version string, event_id string, ts string, collector {COLLECTOR}, "
    f"session_id string, attribution {ATTRIBUTION}, type string"
)
# A stored fact: header, one non-null payload, parsed instants, arrival order.
FACTS = (
    f"{HEADER}, ts_ms bigint, t_start_ms bigint, t_end_ms bigint, arrival bigint, "
    + ", ".join(f"{name} {ddl}" for name, ddl in PAYLOADS.items())
)
IMPACTS = "array<struct<criterion:string,unit:string,min:double,max:double>>"
ESTIMATES = (
    "event_id string, session_id string, status string, methodology_version string, "
    f"region_id string, region_source string, latency_missing boolean, impacts {IMPACTS}"
)
REJECTS = (
    "key string, batch bigint, id bigint, ts string, source string, origin string, reason_kind string, reason string, "
    "attribute_keys array<string>, bytes bigint"
)
