"""The measurement suite: arms, tasks, what is done, and reports over summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPETITIONS = (1, 2, 3, 4, 8, 16, 24, 32, 48, 64, 96, 128)
INTERVENTIONS = ("full", "suffix_distractor", "prefix_distractor", "both_distractor")
#: Prefix and suffix lengths that share a context of 100.
SPLITS = tuple((p, 100 - p) for p in (0, 1, 5, 10, 20, 40, 60, 80, 100))
ARM = "arm_id string, experiment string, eval_kind string, display_label string, model_label string, prompt_format string, context_intervention string, prefix_length int, middle_length int, suffix_length int, window_layout string, window_stride int"
#: Names that summaries on disk are keyed by.
EXPERIMENTS = ("ltr", "prefix_rescue", "attention_ltr", "attention_native_geometry")
LAYOUTS = ("matched_context", "cooper_nonoverlap")
LABELS = {"no_fim": "no-FIM", "fim_v2": "FIM-v2", "fineweb_only": "FineWeb-only"}


def arms() -> list[tuple]:
    """Arms with the names, labels and geometry that must match (fixed values)."""
    rows = [(f"{m}_ltr_p100_m32", "ltr", "direct", f"{x} LTR (100L)", m, "ltr_prefix", "full", 100, 32, 0, LAYOUTS[1], 132) for m, x in LABELS.items()]
    rows += [(f"fim_v2_prefix_rescue_p{p}_s{s}_{i}", "prefix_rescue", "direct", f"FIM-v2 native {p}L/{s}R ({i})", "fim_v2", "fim_native", i, p, 20, s, LAYOUTS[0], 120) for i in INTERVENTIONS for p, s in SPLITS]
    rows += [(f"attn_{m}_ltr_p100_m20", "attention_ltr", "attention", f"{LABELS[m]} LTR attention (100L)", m, "ltr_prefix", "full", 100, 20, 0, LAYOUTS[1], 120) for m in ("no_fim", "fim_v2")]
    rows += [(f"attn_fim_v2_native_p{p}_s{s}", "attention_native_geometry", "attention", f"FIM-v2 native attention {p}L/{s}R", "fim_v2", "fim_native", "full", p, 20, s, LAYOUTS[0], 120) for p, s in SPLITS if p not in (1, 5, 10)]
    return rows


def arm_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(arms(), ARM)


def tasks(spark: SparkSession, repetitions: tuple[int, ...] = REPETITIONS) -> DataFrame:
    """Arms by repetitions, numbered repetition first: both are short lists of the configuration."""
    rows = [(i * len(arms()) + j, r, a[0]) for i, r in enumerate(repetitions) for j, a in enumerate(arms())]
    return spark.createDataFrame(rows, "task_index long, repetition int, arm_id string").join(F.broadcast(arm_table(spark)), "arm_id")


def pending(todo: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a summary of the same configuration whose windows are all there."""
    return todo.join(summaries.filter("num_windows = num_selected_windows").select(*keys).distinct(), keys, "left_anti")


def chosen(arms: DataFrame, experiments: list[str] | None = None, kinds: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Arms of the experiments, kinds and models asked for; a name that no arm has is an error. "all" names every experiment."""
    asked = {"experiment": None if experiments and "all" in experiments else experiments, "eval_kind": kinds, "model_label": models}
    for column, names in asked.items():
        if names:
            known = {r[0] for r in arms.select(column).distinct().collect()}  # a short list of the configuration
            if unknown := sorted(set(names) - known):
                raise ValueError(f"no arm has {column} {', '.join(unknown)}")
            arms = arms.filter(F.col(column).isin(names))
    return arms


def mismatches(summaries: DataFrame, expected: dict) -> DataFrame:
    """A row for each field of a summary that differs from what is expected: arm_id, field, found, wanted (as strings)."""
    rows = [F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("found"), F.lit(str(v)).alias("wanted")) for k, v in expected.items()]
    out = summaries.select("arm_id", F.explode(F.array(*rows)).alias("x")).select("arm_id", "x.*")
    return out.filter(~F.col("found").eqNullSafe(F.col("wanted")))


def gaps(series: DataFrame, keys: list[str], column: str, expected: list) -> DataFrame:
    """Keys whose series lacks an expected value, has another, or has one twice: missing, unknown, repeated."""
    seen = series.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("seen"), (F.count(column) - F.countDistinct(column)).alias("repeated"))
    want = F.array(*(F.lit(x) for x in expected)).cast(seen.schema["seen"].dataType)
    out = seen.select(*keys, F.array_except(want, "seen").alias("missing"), F.array_except("seen", want).alias("unknown"), "repeated")
    return out.filter((F.size("missing") > 0) | (F.size("unknown") > 0) | (F.col("repeated") > 0))


def report_arms(df: DataFrame, experiment: str) -> DataFrame:
    if experiment == "native_geometry":
        return df.filter((F.col("experiment") == "prefix_rescue") & (F.col("context_intervention") == "full"))
    return df.filter(F.col("experiment") == experiment)


def parse_splits(text: str, budget: int) -> list[tuple[int, int]]:
    """"p:s,p:s" -> pairs, repeated ones once, each summing to the budget."""
    out: list[tuple[int, int]] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        p, s = (int(x) for x in part.split(":"))
        if p < 0 or s < 0 or p + s != budget:
            raise ValueError(f"{part} does not share {budget}")
        if (p, s) not in out:
            out.append((p, s))
    if not out:
        raise ValueError("no split is given")
    return out
