"""Attention by segment of the key: masses, entropy and distance, over heads and queries, then layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import NAN

SEGMENTS = ("prefix", "suffix", "target_prev", "fim_marker")


def bands(layers: int) -> dict[str, tuple[int, int]]:
    """Layers of the early, middle and late third; the first two have one layer at least."""
    first = max(1, layers // 3)
    second = max(first + 1, 2 * layers // 3)
    return {"early": (0, first), "mid": (first, second), "late": (second, layers)}


#: Names of prompt formats.
FORMATS = ("ltr_prefix", "fim_native")


def layout(rows: DataFrame, format: str, prefix: str, suffix: str, target: str) -> DataFrame:
    """Adds what profile() takes as bounds, from columns with a prompt's format and lengths; and prompt_length, sequence_length.

    ltr_prefix is the prefix and then the target; fim_native is a mark, the prefix, a mark, the suffix, a mark, and
    then the target. The first query is the prompt's last place, as it tells the target's first token; there are as
    many queries as target tokens. Another format is an error.
    """
    p, s, t = (F.col(c).cast("int") for c in (prefix, suffix, target))
    fim = F.col(format) == FORMATS[1]
    known = F.when(F.col(format).isin(*FORMATS), F.col(format)).otherwise(F.raise_error(F.concat(F.lit("no prompt format is called "), F.coalesce(F.col(format), F.lit("null")))))
    rows = rows.withColumn(format, known).withColumn("prompt_length", F.when(fim, p + s + 3).otherwise(p))
    begin = F.when(fim, 1).otherwise(0)
    return rows.withColumns({
        "sequence_length": F.col("prompt_length") + t, "prefix_begin": begin, "prefix_end": begin + p, "suffix_begin": F.when(fim, p + 2).otherwise(0), "suffix_end": F.when(fim, p + 2 + s).otherwise(0),
        "marks": F.when(fim, F.array(F.lit(0), p + 1, p + s + 2)).otherwise(F.array().cast("array<int>")), "target_begin": F.col("prompt_length"), "target_end": F.col("prompt_length") + t, "first_query": F.col("prompt_length") - 1,
    })


def roles() -> Column:
    """The role of each place of a layout()'s sequence, a letter a place: M a mark, P prefix, S suffix, T target."""
    part = lambda c, a, b: F.repeat(F.lit(c), F.col(b) - F.col(a))
    fim = F.size("marks") > 0
    prefix, suffix, target = part("P", "prefix_begin", "prefix_end"), part("S", "suffix_begin", "suffix_end"), part("T", "target_begin", "target_end")
    return F.when(fim, F.concat(F.lit("M"), prefix, F.lit("M"), suffix, F.lit("M"), target)).otherwise(F.concat(prefix, target))


#: What a window's weights are told apart by.
BOUNDS = ("prefix_begin", "prefix_end", "suffix_begin", "suffix_end", "marks", "target_begin", "target_end", "first_query")


def profile(weights: DataFrame, bounds: DataFrame | None, layers: int) -> DataFrame:
    """weights (w, l, h, q, k, a): a weight for each window, layer, head, query and key; bounds, a row a window:
    prefix_begin, prefix_end, suffix_begin, suffix_end, marks (array of keys), target_begin, target_end, first_query.
    Without bounds, weights have these columns: a join's planner knows a model's input, not how many weights come out,
    and may send them all to the driver.

    Gives w and the thirty attn_ columns. Of the target only keys before the query count. A window without later
    queries, or a band without layers, gives NaN. Sums over keys and means over heads and queries are partial
    aggregates; rows of one window need not meet before.
    """
    x = weights if bounds is None else weights.join(bounds, "w")
    k, q, a = F.col("k"), F.col("q"), F.col("a")
    mark = F.array_contains("marks", k)
    at = {
        "prefix": ~mark & (k >= F.col("prefix_begin")) & (k < F.col("prefix_end")), "suffix": ~mark & (k >= F.col("suffix_begin")) & (k < F.col("suffix_end")),
        "target_prev": ~mark & (k >= F.col("target_begin")) & (k < F.col("target_end")) & (k <= q), "fim_marker": mark,
    }
    mass = lambda c: F.sum(F.when(c, a).otherwise(0.0))
    rows = x.groupBy("w", "l", "h", "q").agg(
        F.first("first_query").alias("fq"), *(mass(c).alias(f"{n}_mass") for n, c in at.items()), (F.sum(-a * F.log(F.greatest(a, F.lit(1e-30)))) / F.greatest(F.log(q + 1), F.lit(1.0))).alias("entropy_norm"),
        F.max("a").alias("max_weight"), F.sum(a * F.greatest(q - k, F.lit(0))).alias("backward_distance"),
    )
    rows = rows.withColumn("backward_distance_norm", F.col("backward_distance") / (q + 1))
    names = [*(f"{n}_mass" for n in SEGMENTS), "entropy_norm", "max_weight", "backward_distance", "backward_distance_norm"]
    first, later = F.col("q") == F.col("fq"), F.col("q") > F.col("fq")
    per = rows.groupBy("w", "l").agg(
        *(F.avg(n).alias(n) for n in names), *(F.avg(F.when(first, F.col(f"{n}_mass"))).alias(f"first_{n}_mass") for n in ("prefix", "suffix", "fim_marker")), *(F.avg(F.when(later, F.col(f"{n}_mass"))).alias(f"later_{n}_mass") for n in SEGMENTS)
    )
    split = {"first": ("prefix", "suffix", "fim_marker"), "later": SEGMENTS}
    whole = [*names, *(f"{s}_{n}_mass" for s, found in split.items() for n in found)]

    def band(name: str, low: int, high: int) -> Column:
        return F.coalesce(F.avg(F.when((F.col("l") >= low) & (F.col("l") < high), F.col(name))), F.lit(NAN))

    out = per.groupBy("w").agg(
        *(F.coalesce(F.avg(n), F.lit(NAN)).alias(f"attn_{n}") for n in whole),
        *(band(n, low, high).alias(f"attn_{b}_{n}") for b, (low, high) in bands(layers).items() for n in ("prefix_mass", "suffix_mass", "target_prev_mass", "entropy_norm")),
    )
    context = F.greatest(F.col("attn_prefix_mass") + F.col("attn_suffix_mass"), F.lit(1e-12))
    out = out.withColumn("attn_prompt_mass", F.col("attn_prefix_mass") + F.col("attn_suffix_mass") + F.col("attn_fim_marker_mass"))
    return out.withColumns({f"attn_{n}_share_of_context": F.col(f"attn_{n}_mass") / context for n in ("prefix", "suffix")})
