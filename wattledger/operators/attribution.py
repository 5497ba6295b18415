"""Apportionment of measured energy over action spans.

Each energy sample is split by the best evidence there is:

* process windows cover it  -> by CPU time (``l2_cpu_time/v1``)
* only spans overlap it     -> by wall clock (``l1_wall_clock/v1``)
* nothing does              -> all of it is baseline

and every joule lands in exactly one of: a span, the orphan bucket, the baseline.

The CPU split never pairs windows with spans.  How many spans claim a pid depends on the sample
alone, so process windows are reduced to CPU per (sample, pid) first, claims to counts per
(sample, pid), and the two meet on that key.  Spans without pids of their own all get the same
amount, the shares of the session's root pids, which is one number per sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import exact_sum, overlap_ms
from wattledger.operators.intervals import overlap_join
from wattledger.session import cut

# Fixed text of the contract.
REMOTE_REASON = "execution_locus: remote — not measured on this machine"


# ---------------------------------------------------------------- inputs


def spans_of(facts: DataFrame) -> DataFrame:
    """Action spans with readable bounds."""
    p = "action_span"
    return facts.where((F.col("type") == p) & F.col("t_start_ms").isNotNull() & F.col("t_end_ms").isNotNull()).select(
        "session_id",
        "event_id",
        "ts_ms",
        F.col(f"{p}.span_id").alias("span_id"),
        F.col(f"{p}.tool_name").alias("tool_name"),
        F.col(f"{p}.tool_kind").alias("tool_kind"),
        F.col(f"{p}.execution_locus").alias("locus"),
        F.col("t_start_ms").alias("span_start"),
        F.col("t_end_ms").alias("span_end"),
        F.array_distinct(F.coalesce(f"{p}.pids", F.array().cast("array<bigint>"))).alias("pids"),
        F.col(f"{p}.status").alias("status"),
        F.col("attribution.task_id").alias("task_id"),
        F.col("attribution.tool_call_id").alias("tool_call_id"),
    )


def sample_joules(components: Column) -> Column:
    """The ``total`` components when there are any, else the sum of all components."""
    totals = F.filter(components, lambda c: c["kind"] == "total")
    chosen = F.when(F.size(totals) > 0, totals).otherwise(components)
    return F.aggregate(chosen, F.lit(0.0), lambda acc, c: acc + c["energy_j"])


def samples_of(facts: DataFrame) -> DataFrame:
    """Energy samples; bounds are null when unreadable."""
    return facts.where(F.col("type") == "energy_sample").select(
        "session_id",
        F.col("event_id").alias("sample_id"),
        "ts_ms",
        F.col("t_start_ms").alias("sample_start"),
        F.col("t_end_ms").alias("sample_end"),
        F.coalesce(sample_joules(F.col("energy_sample.components")), F.lit(0.0)).alias("energy_j"),
    )


def per_pid(processes: Column) -> Column:
    """One entry per pid: the largest delta, tagged when any of its entries is an orphan's.

    A pid can be listed more than once (two watches on one tree); adding the deltas would count
    the same CPU time twice.
    """
    tagged = F.transform(F.filter(processes, lambda p: p["orphan_of"].isNotNull()), lambda p: p["pid"])
    ordered = F.array_sort(
        F.transform(processes, lambda p: F.struct(p["pid"].alias("pid"), p["cpu_time_delta_ms"].alias("cpu_ms")))
    )
    largest = F.filter(
        ordered, lambda e, i: (i == F.size(ordered) - 1) | (F.try_element_at(ordered, i + 2)["pid"] != e["pid"])
    )
    return F.transform(
        largest,
        lambda e: F.struct(
            e["pid"].alias("pid"), e["cpu_ms"].alias("cpu_ms"), F.array_contains(tagged, e["pid"]).alias("tagged")
        ),
    )


def windows_of(facts: DataFrame) -> DataFrame:
    """Process windows with per-pid CPU; degenerate and unreadable ones are kept for counting."""
    return facts.where(F.col("type") == "process_sample").select(
        "session_id",
        F.col("event_id").alias("window_id"),
        "ts_ms",
        F.col("t_start_ms").alias("window_start"),
        F.col("t_end_ms").alias("window_end"),
        per_pid(F.coalesce("process_sample.processes", F.array().cast(f"array<{S.PROCESS}>"))).alias("pid_cpu"),
    )


def root_pids_of(spans: DataFrame) -> DataFrame:
    """The session's own process tree: distinct pids of its bootstrap spans, one row each."""
    return (
        spans.where(F.col("tool_name") == S.BOOTSTRAP_TOOL)
        .select("session_id", F.explode("pids").alias("pid"))
        .distinct()
    )


# ---------------------------------------------------------------- predicates


def is_attributable() -> Column:
    return (F.col("span_end") > F.col("span_start")) & (F.col("locus") != "remote")


def is_degenerate() -> Column:
    return (
        (F.col("span_end") <= F.col("span_start"))
        & (F.col("locus") != "remote")
        & (F.col("tool_name") != S.BOOTSTRAP_TOOL)
    )


def measurable(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("sample_end") > F.col("sample_start"))


def usable_windows(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("window_end") > F.col("window_start"))


# ---------------------------------------------------------------- candidate joins

_SAMPLE = ("sample_start", "sample_end")
_SPAN = ("span_start", "span_end")


def covering_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Sample x process window pairs, with the fraction of the window inside the sample."""
    pairs = overlap_join(
        measurable(samples).select("session_id", "sample_id", *_SAMPLE),
        usable_windows(windows).select("session_id", "window_id", "window_start", "window_end", "pid_cpu"),
        ["session_id"],
        _SAMPLE,
        ("window_start", "window_end"),
    )
    length = F.col("window_end") - F.col("window_start")
    return pairs.withColumn("fraction", overlap_ms("window_start", "window_end", *_SAMPLE) / length)


def active_spans(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Sample x attributable span-event pairs."""
    pairs = overlap_join(
        measurable(samples).select("session_id", "sample_id", *_SAMPLE),
        spans.where(is_attributable()).select(
            "session_id", "event_id", "span_id", "tool_name", "locus", "span_start", "span_end", "pids"
        ),
        ["session_id"],
        _SAMPLE,
        _SPAN,
    )
    return pairs.withColumn("overlap_ms", overlap_ms(*_SPAN, *_SAMPLE))


def _overlapping(samples: DataFrame, spans: DataFrame) -> DataFrame:
    pairs = overlap_join(
        measurable(samples).select("session_id", "sample_id", *_SAMPLE),
        spans.select("session_id", "event_id", "span_id", "tool_name", "locus", "span_start", "span_end"),
        ["session_id"],
        _SAMPLE,
        _SPAN,
    )
    return pairs.withColumn("overlap_ms", overlap_ms(*_SPAN, *_SAMPLE))


def remote_overlaps(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Sample x remote span pairs, also zero-length ones strictly inside a sample."""
    return _overlapping(samples, spans.where(F.col("locus") == "remote"))


def degenerate_overlaps(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Sample x local span without duration."""
    return _overlapping(samples, spans.where(is_degenerate()))


def unmeasured_spans(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Per session: remote spans and local ones without duration that overlap samples, from one join; null for none."""
    remote = F.col("locus") == "remote"
    pairs = _overlapping(samples, spans.where(remote | is_degenerate())).select("session_id", remote.alias("remote"), "span_id").where("span_id is not null").distinct()
    return pairs.groupBy("session_id").agg(
        F.nullif(F.count_if("remote"), F.lit(0)).alias("unmeasured_remote_spans"),
        F.nullif(F.count_if(~F.col("remote")), F.lit(0)).alias("degenerate_spans"),
    )


def distinct_spans_per_session(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.groupBy("session_id").agg(F.countDistinct("span_id").alias(name))


# ---------------------------------------------------------------- CPU weights


def pid_usage(covering: DataFrame) -> DataFrame:
    """CPU per (sample, pid), clean and orphan-tagged apart.

    A sample covered only by windows that list nothing keeps one row with a null pid.
    """
    rows = covering.select("session_id", "sample_id", "fraction", F.explode_outer("pid_cpu").alias("p"))
    cpu = F.col("p.cpu_ms") * F.col("fraction")
    return rows.groupBy("session_id", "sample_id", F.col("p.pid").alias("pid")).agg(
        F.coalesce(exact_sum(F.when(~F.col("p.tagged"), cpu)), F.lit(0.0)).alias("clean_ms"),
        F.coalesce(exact_sum(F.when(F.col("p.tagged"), cpu)), F.lit(0.0)).alias("tagged_ms"),
    )


def pid_claims(active: DataFrame) -> DataFrame:
    """(sample, pid, span event) for spans that list their own pids."""
    return active.select(
        "sample_id", "event_id", "span_id", F.explode("pids").alias("pid")
    )


def sample_activity(active: DataFrame) -> DataFrame:
    """Per sample: active span events, those inheriting the root tree, and claimed wall clock."""
    return active.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.count_if(F.size("pids") == 0).alias("n_inherit"),
        F.sum("overlap_ms").alias("active_overlap_ms"),
    )


def pid_shares(usage: DataFrame, claims: DataFrame, activity: DataFrame, root_pids: DataFrame) -> DataFrame:
    """What one claimant, and the orphan bucket, get of each (sample, pid).

    The CPU of a pid is divided equally among its claimants; an orphan tag adds the orphan bucket
    as one more, and a pid nobody claims is the orphan bucket's alone.
    """
    counts = claims.groupBy("sample_id", "pid").agg(F.count(F.lit(1)).alias("n_own"))
    roots = root_pids.select("session_id", "pid", F.lit(True).alias("is_root"))
    joined = (
        usage.join(roots, ["session_id", "pid"], "left")
        .join(counts, ["sample_id", "pid"], "left")
        .join(activity.select("sample_id", "n_inherit"), "sample_id", "left")
        .withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    )
    inherit = F.when(F.col("is_root"), F.coalesce("n_inherit", F.lit(0))).otherwise(F.lit(0))
    n = F.coalesce("n_own", F.lit(0)) + inherit
    return joined.select(
        "session_id",
        "sample_id",
        "pid",
        "is_root",
        n.alias("claimants"),
        (F.col("clean_ms") + F.col("tagged_ms")).alias("cpu_ms"),
        F.when(n > 0, F.col("clean_ms") / n + F.col("tagged_ms") / (n + 1)).otherwise(F.lit(0.0)).alias("claim_ms"),
        F.when(n > 0, F.col("tagged_ms") / (n + 1))
        .otherwise(F.col("clean_ms") + F.col("tagged_ms"))
        .alias("orphan_ms"),
    )


def sample_weights(shares: DataFrame) -> DataFrame:
    """Per covered sample: total, orphan, root-tree and inherited CPU weight."""
    zero = F.lit(0.0)
    return shares.groupBy("sample_id").agg(
        F.coalesce(exact_sum(F.col("claim_ms") * F.col("claimants") + F.col("orphan_ms")), zero).alias("total_w"),
        F.coalesce(exact_sum("orphan_ms"), zero).alias("orphan_w"),
        F.coalesce(exact_sum(F.when(F.col("is_root"), F.col("cpu_ms"))), zero).alias("root_cpu_ms"),
        F.coalesce(exact_sum(F.when(F.col("is_root"), F.col("claim_ms"))), zero).alias("inherit_w"),
        F.bool_and(F.col("pid").isNull()).alias("unobserved"),
    )


def own_weights(claims: DataFrame, shares: DataFrame) -> DataFrame:
    """CPU weight of each (sample, span event) that lists pids."""
    return (
        claims.join(shares.select("sample_id", "pid", "claim_ms"), ["sample_id", "pid"])
        .groupBy("sample_id", "event_id")
        .agg(exact_sum("claim_ms").alias("own_w"))
    )


# ---------------------------------------------------------------- apportionment


@dataclass(frozen=True)
class Apportionment:
    """``samples``: one row per readable sample.  ``rows``: one per (sample, active span event)."""

    samples: DataFrame
    rows: DataFrame


def _policy() -> Column:
    nothing = F.coalesce("n_active", F.lit(0)) == 0
    return (
        F.when(F.col("sample_end") <= F.col("sample_start"), F.lit(S.POLICY_NONE))
        .when(F.col("covered") & ~(nothing & (F.col("orphan_w") <= 0)), F.lit(S.POLICY_L2))
        .when(~F.col("covered") & ~nothing, F.lit(S.POLICY_L1))
        .otherwise(F.lit(S.POLICY_NONE))
    )


def apportion(samples: DataFrame, spans: DataFrame, windows: DataFrame, root_pids: DataFrame) -> Apportionment:
    covering = covering_windows(samples, windows)
    # Both are needed by several branches below, and the interval joins behind them are the
    # expensive part.
    active = cut(active_spans(samples, spans))
    claims = pid_claims(active)
    activity = sample_activity(active)
    shares = cut(pid_shares(pid_usage(covering), claims, activity, root_pids))
    weights = sample_weights(shares)

    readable = samples.where(F.col("sample_start").isNotNull() & F.col("sample_end").isNotNull())
    header = (
        readable.join(activity, "sample_id", "left")
        .join(weights.withColumn("covered", F.lit(True)), "sample_id", "left")
        .withColumns({"covered": F.coalesce("covered", F.lit(False)), "window_ms": F.col("sample_end") - F.col("sample_start")})
        .withColumn("policy_id", _policy())
    )
    window = F.col("window_ms").cast("double")
    l2 = F.col("policy_id") == S.POLICY_L2
    l1 = F.col("policy_id") == S.POLICY_L1
    has_w = F.col("total_w") > 0
    # One core-second per second is the whole sample; more CPU than that cannot cost more.
    active_j = F.col("energy_j") * F.least(F.lit(1.0), F.col("total_w") / window)
    claimed = F.col("active_overlap_ms") / window
    header = header.withColumns(
        {
            "j_per_cpu_ms": F.when(l2 & has_w, active_j / F.col("total_w")).otherwise(F.lit(0.0)),
            "j_per_wall_ms": F.when(
                l1, F.col("energy_j") / window * F.when(claimed > 1, 1 / claimed).otherwise(F.lit(1.0))
            ).otherwise(F.lit(0.0)),
        }
    )
    zero = F.lit(0.0)
    orphaned = F.when(l2 & has_w, F.col("j_per_cpu_ms") * F.col("orphan_w")).otherwise(zero)
    to_spans = (
        F.when(l2 & has_w, F.col("j_per_cpu_ms") * (F.col("total_w") - F.col("orphan_w")))
        .when(l1, F.col("j_per_wall_ms") * F.col("active_overlap_ms"))
        .otherwise(zero)
    )
    header = (
        header.withColumns({"orphaned_j": orphaned, "attributed_j": to_spans})
        .withColumn("baseline_j", F.col("energy_j") - F.col("attributed_j") - F.col("orphaned_j"))
        .withColumn(
            "l1_shadow_sum_share",
            F.when((F.col("policy_id") != S.POLICY_NONE) & (window > 0), F.coalesce(claimed, zero)).otherwise(zero),
        )
        .withColumn("denominator_cpu_ms", F.greatest(window, zero))
        .withColumn("root_cpu_ms", F.coalesce("root_cpu_ms", zero))
        .withColumn("unobserved", F.coalesce("unobserved", F.lit(False)))
    )

    placed = header.where(F.col("policy_id") != S.POLICY_NONE).select(
        "sample_id", "energy_j", "window_ms", "policy_id", "inherit_w", "j_per_cpu_ms", "j_per_wall_ms"
    )
    rows = active.join(own_weights(claims, shares), ["sample_id", "event_id"], "left").join(placed, "sample_id")
    weight = F.when(F.col("policy_id") != S.POLICY_L2, zero).otherwise(
        F.coalesce(F.when(F.size("pids") == 0, F.col("inherit_w")).otherwise(F.col("own_w")), zero)
    )
    joules = F.when(F.col("policy_id") == S.POLICY_L2, weight * F.col("j_per_cpu_ms")).otherwise(
        F.col("overlap_ms") * F.col("j_per_wall_ms")
    )
    rows = rows.select(
        "session_id",
        "sample_id",
        "event_id",
        "span_id",
        "tool_name",
        "locus",
        "policy_id",
        "overlap_ms",
        weight.alias("cpu_weight_ms"),
        joules.alias("event_j"),
        (F.col("energy_j") * F.col("overlap_ms") / F.col("window_ms")).alias("l1_allocated_j"),
    )
    return Apportionment(
        header.select(
            "session_id", "sample_id", "ts_ms", "sample_start", "sample_end", "energy_j", "policy_id",
            "attributed_j", "orphaned_j", "baseline_j", "denominator_cpu_ms", "l1_shadow_sum_share",
            "root_cpu_ms", "unobserved",
        ),
        rows,
    )


def apportion_facts(facts: DataFrame) -> Apportionment:
    spans = spans_of(facts)
    return apportion(samples_of(facts), spans, windows_of(facts), root_pids_of(spans))


def span_energy(app: Apportionment) -> DataFrame:
    """Joules and CPU weight per (session, span); events that share an id are one payee."""
    return app.rows.groupBy("session_id", "span_id").agg(
        exact_sum("event_j").alias("allocated_j"),
        exact_sum("cpu_weight_ms").alias("cpu_weight_ms"),
        F.countDistinct("sample_id").alias("samples"),
    )


def trace_rows(app: Apportionment, samples: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per (sample, overlapping span event); events of one span id repeat its joules.

    Remote spans are listed with nothing and the reason.
    """
    paid = app.rows.groupBy("sample_id", "span_id").agg(
        exact_sum("event_j").alias("allocated_j"), exact_sum("cpu_weight_ms").alias("cpu_delta_ms")
    )
    local = app.rows.join(paid, ["sample_id", "span_id"]).select(
        "session_id", "sample_id", "event_id", "span_id", "tool_name", "locus", "overlap_ms",
        "cpu_delta_ms", "allocated_j", "l1_allocated_j",
        F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("excluded_reason"),
    )
    zero = F.lit(0.0)
    remote = remote_overlaps(samples, spans).select(
        "session_id", "sample_id", "event_id", "span_id", "tool_name", "locus", "overlap_ms",
        zero.alias("cpu_delta_ms"), zero.alias("allocated_j"), zero.alias("l1_allocated_j"),
        F.lit(True).alias("excluded"), F.lit(REMOTE_REASON).alias("excluded_reason"),
    )
    return local.unionByName(remote)


def session_energy(app: Apportionment) -> DataFrame:
    """Per session: totals by bucket, policy counters, applied and recorded policy."""
    l1 = F.count_if(F.col("policy_id") == S.POLICY_L1)
    l2 = F.count_if(F.col("policy_id") == S.POLICY_L2)
    out = app.samples.groupBy("session_id").agg(
        exact_sum("attributed_j").alias("attributed_j"),
        exact_sum("orphaned_j").alias("orphaned_j"),
        exact_sum("baseline_j").alias("baseline_j"),
        exact_sum("energy_j").alias("energy_j"),
        l1.alias("samples_l1"),
        l2.alias("samples_l2"),
        F.count_if(F.col("sample_end") <= F.col("sample_start")).alias("degenerate_samples"),
        F.count_if("unobserved").alias("unobserved_process_windows"),
        F.count(F.lit(1)).alias("samples"),
    )
    applied = F.when(F.col("samples_l2") > 0, F.lit(S.POLICY_L2)).when(
        F.col("samples_l1") > 0, F.lit(S.POLICY_L1)
    )
    return out.withColumns(
        {
            "applied_policy_id": F.coalesce(applied, F.lit(S.POLICY_NONE)),
            "policy_id": F.coalesce(applied, F.lit(S.POLICY_L1)),
        }
    )


def skipped_events(facts: DataFrame) -> DataFrame:
    """Per session: spans, samples and process windows that could not be used."""
    unreadable = F.col("t_start_ms").isNull() | F.col("t_end_ms").isNull()
    unusable = F.when(
        F.col("type") == "process_sample", unreadable | (F.col("t_end_ms") <= F.col("t_start_ms"))
    ).otherwise(unreadable)
    timed = facts.where(F.col("type").isin("action_span", "energy_sample", "process_sample"))
    return timed.groupBy("session_id").agg(F.count_if(unusable).alias("skipped_events"))


def conservation_violations(app: Apportionment, tolerance: float = 1e-6) -> DataFrame:
    """Samples whose paid, orphaned and baseline joules do not add up to what was measured."""
    paid = app.rows.groupBy("sample_id").agg(exact_sum("event_j").alias("paid_j"))
    total = F.coalesce("paid_j", F.lit(0.0)) + F.col("orphaned_j") + F.col("baseline_j")
    return (
        app.samples.join(paid, "sample_id", "left")
        .withColumn("accounted_j", total)
        .where(F.abs(F.col("accounted_j") - F.col("energy_j")) > tolerance * F.greatest(F.lit(1.0), F.abs("energy_j")))
        .select("session_id", "sample_id", "energy_j", "accounted_j")
    )
