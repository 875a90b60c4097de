"""Recorded agent runs: steps, tools, stop reasons, subtasks and workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from retrievo.functions.text import is_blank, strip
from retrievo.operators.ordered import row_numbers, spans

MAX_STEPS = 10
MAX_REPEATED = 3
MAX_SUBTASKS = 5
TIMEOUT_MS = 180_000
# Tool names, error prefixes and rate-limit phrases.
TOOLS = ("query_database", "call_external_api")
TOOL_ERROR_PREFIXES = ("Error:", "参数解析失败")
RATE_LIMIT_PHRASES = ("429", "rate limit", "too many requests", "throttling", "rate_limit_exceeded",
                      "请求过于频繁", "请求频率超限")
# Layout of a step in plain text.
ACTION_PATTERN = r"(?s)Action:\s*(\w+)\s*Action\s+Input:\s*(.+?)(?=Thought:|Observation:|Final Answer:|$)"
FINAL_PATTERN = r"(?s)Final Answer:\s*(.+)"
THOUGHT_PATTERN = r"(?s)Thought:\s*(.+?)(?=Action:|Final Answer:|$)"
SUBTASK_PATTERN = r"SUBTASK\s+(\d+):\s*(.+)"


def strip_fence(col: Column) -> Column:
    """Text inside a code fence, or the trimmed text."""
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(text.rlike(r"(?s)^```.*\n.*```$"), strip(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```$", 1))) \
        .otherwise(text)


def _group(col: Column, pattern: str, index: int = 1) -> Column:
    return F.when(col.rlike(pattern), strip(F.regexp_extract(col, pattern, index)))


def parse_steps(df: DataFrame, output: str = "llm_output") -> DataFrame:
    """Add thought, action, action_input and final_answer from JSON steps, or from the labelled text form."""
    body = strip_fence(F.col(output))
    fields = F.from_json(body, "thought string, action string, actionInput string, finalAnswer string, _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = F.coalesce(F.col(output), F.lit(""))
    parsed = df.withColumn("_j", fields)
    is_json = F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.startswith(body, F.lit("{"))
    final = _group(raw, FINAL_PATTERN)
    plain = lambda i: F.when(final.isNull(), _group(raw, ACTION_PATTERN, i))
    pick = lambda name, legacy: F.when(is_json, F.col(f"_j.{name}")).otherwise(legacy)
    return (parsed.withColumn("thought", pick("thought", _group(raw, THOUGHT_PATTERN)))
            .withColumn("action", pick("action", plain(1)))
            .withColumn("action_input", pick("actionInput", plain(2)))
            .withColumn("final_answer", pick("finalAnswer", final)).drop("_j"))


def tool_status(action: Column, observation: Column, tools: Sequence[str] = TOOLS) -> Column:
    """unknown_tool, tool_error (error prefix, or HTTP status of 400 and more) or success."""
    failed = F.lit(False)
    for p in TOOL_ERROR_PREFIXES:
        failed = failed | F.startswith(observation, F.lit(p))
    code = F.regexp_extract(strip(observation), r"^Status:\s*(\d{3})", 1)
    failed = failed | ((code != "") & (code.try_cast("int") >= 400))
    return (F.when(~action.isin(*tools) | action.isNull(), "unknown_tool")
            .when(F.coalesce(failed, F.lit(False)), "tool_error").otherwise("success"))


def repeated(df: DataFrame, n: int = MAX_REPEATED, run: str = "run_id", step: str = "step",
             observation: str = "observation", span: int = 1024) -> DataFrame:
    """Add ``repeated``: the observation equals those of the ``n - 1`` steps before it.

    Step numbers may have gaps. A long run is worked on in spans of its steps in order.
    """
    ordered = row_numbers(df, [run], [step], F.floor(F.col(step) / span), "_row")
    w = Window.partitionBy(run, "span").orderBy("_row")
    cut = spans(ordered, "_row", span, n - 1).withColumn("repeated", _same_as_before(n, observation, w))
    return cut.filter("NOT copied").drop("span", "copied", "_row")


def _same_as_before(n: int, observation: str, w) -> Column:
    same = F.col(observation).isNotNull()
    for i in range(1, n):
        same = same & (F.lag(observation, i).over(w) == F.col(observation))
    return F.coalesce(same, F.lit(False))


def stop_reasons(steps: DataFrame, max_steps: int = MAX_STEPS, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """One row per run from parsed steps (run_id, step, llm_error, latency_ms, observation, action, final_answer).

    The first step that ends the run decides; a run without one stops at ``max_steps``. Steps after it do not count, and
    a step starts only while the time used before it is within the timeout.
    """
    steps = steps.filter(F.col("step") <= max_steps)  # a run is at most max_steps rows from here on
    w = Window.partitionBy("run_id").orderBy("step")
    used = F.coalesce(F.sum("latency_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = steps.withColumns({"_before": used, "repeated": _same_as_before(MAX_REPEATED, "observation", w)})
    reason = (F.when(F.col("_before") > timeout_ms, "timeout")
              .when(F.col("llm_error"), "llm_error")
              .when(~is_blank(F.col("final_answer")), "final_answer")
              .when(is_blank(F.col("action")), "no_action")
              .when(F.col("repeated"), "repeated_observation"))
    ended = marked.withColumn("_reason", reason)
    first = ended.groupBy("run_id").agg(F.min(F.when(F.col("_reason").isNotNull(), F.struct("step", "_reason")))
                                        .alias("_end"))
    bad = F.col("tool_status").isin("tool_error", "unknown_tool")
    counted = ended.withColumn("tool_status", F.when(
        ~is_blank(F.col("action")) & is_blank(F.col("final_answer")) & ~F.col("llm_error"),
        tool_status(F.col("action"), F.col("observation")))).join(first, "run_id").filter(
        F.col("_end").isNull() | (F.col("step") <= F.col("_end.step"))).filter(
        F.coalesce(F.col("_reason") != "timeout", F.lit(True)))
    summed = counted.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("step_count"), F.max(~is_blank(F.col("action"))).alias("tool_used"),
        F.max(F.coalesce(bad, F.lit(False))).alias("tool_error"), F.sum("latency_ms").alias("total_latency_ms"))
    stop = F.coalesce(F.col("_end._reason"), F.lit("max_steps"))
    return first.join(summed, "run_id", "left").select(
        "run_id", stop.alias("stop_reason"), (stop == "final_answer").alias("completed"),
        F.coalesce("step_count", F.lit(0)).alias("step_count"), F.coalesce("tool_used", F.lit(False)).alias("tool_used"),
        F.coalesce("tool_error", F.lit(False)).alias("tool_error"),
        F.coalesce("total_latency_ms", F.lit(0)).alias("total_latency_ms"))


def subtasks(df: DataFrame, key: str, task: str = "task", response: str = "response", n: int = MAX_SUBTASKS,
             blank: bool = False) -> DataFrame:
    """The first ``n`` subtasks of a plan; the whole task where the plan names none. A blank plan or task gives nothing,
    unless ``blank`` says that only a missing one does."""
    found = F.filter(F.transform(F.regexp_extract_all(F.col(response), F.lit(SUBTASK_PATTERN), 2), strip),
                     lambda s: s != "")
    missing = F.isnull if blank else is_blank
    whole = F.when(~missing(F.col(response)) & ~missing(F.col(task)), F.array(F.col(task))).otherwise(
        F.array().cast("array<string>"))
    return df.select(key, F.posexplode(F.slice(F.when(F.size(found) > 0, found).otherwise(whole), 1, n))
                     .alias("_i", "subtask")).select(key, (F.col("_i") + 1).alias("index"), "subtask")


def worker_rollup(workers: DataFrame, key: str = "run_id", synthesis_fallback: str = "synthesis_fallback") -> DataFrame:
    """Workers, failures and stop reason per multi-agent run (status, latency_ms, synthesis_fallback)."""
    failed = F.count(F.when(F.col("status") != "success", 1))
    out = workers.groupBy(key).agg(F.count(F.lit(1)).alias("workers"), failed.alias("failures"),
                                   F.max("latency_ms").alias("slowest_ms"), F.max(synthesis_fallback).alias("_f"))
    return out.withColumn("stop_reason", F.when(F.col("_f"), "synthesis_fallback").when(
        F.col("failures") > 0, "partial_worker_failure").otherwise("completed")).drop("_f")


def is_rate_limit(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for p in RATE_LIMIT_PHRASES:
        out = out | F.contains(low, F.lit(p))
    return out
