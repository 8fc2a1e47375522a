"""Outputs for readers: audited windows as CSV with an index page, and the findings of a suite as text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .files import write_csv

LINE = ("example_id", "pair_id", "model", "repetition", "excerpt_id", "target_start", "p_z", "log_p_z", "log_p_z_delta", "target_text")


def plain_line(c: str) -> F.Column:
    """Text that stays on one line of a CSV."""
    return F.replace(F.replace(F.col(c), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def audit_index(selected: DataFrame, tokens: DataFrame) -> DataFrame:
    """selected (example_id, log_p_z, ...) with the log-probability summed again over tokens (example_id, logprob).

    The difference is null where either is not finite or a window has no tokens.
    """
    again = tokens.groupBy("example_id").agg(F.sum("logprob").alias("recomputed_log_p_z"))
    delta = F.col("recomputed_log_p_z") - F.col("log_p_z")
    finite = (F.abs("recomputed_log_p_z") < float("inf")) & (F.abs("log_p_z") < float("inf"))
    return selected.join(again, "example_id", "left").withColumn("log_p_z_delta", F.when(finite, delta))


def index_page(rows: Iterable[Row], title: str = "Audited windows") -> Iterator[str]:
    """Markdown lines: a section a pair, an entry a window, in the rows' order."""
    yield f"# {title}"
    pair = None
    for r in rows:
        if r.pair_id != pair:
            pair = r.pair_id
            yield f"\n## {pair}"
        delta = "not comparable" if r.log_p_z_delta is None else f"{r.log_p_z_delta:+.3g}"
        yield f"\n### {r.example_id}: {r.model}\n"
        yield f"- excerpt `{r.excerpt_id}` from token {r.target_start}, repetition {r.repetition}"
        yield f"- p_z {r.p_z:.6g}; summed again, its logarithm differs by {delta}"
        yield f"- target: {(r.target_text or '').replace(chr(10), ' / ')}"


def write_audit(selected: DataFrame, tokens: DataFrame, words: DataFrame, path: str) -> None:
    """index, tokens and words as CSV below path, and index.md as text. The windows of an audit are chosen by hand or by rank: few."""
    index = audit_index(selected, tokens)
    text = [c for c, t in index.dtypes if t == "string"]
    write_csv([index.withColumns({c: plain_line(c) for c in text})], f"{path}/index")
    for name, rows in (("tokens", tokens), ("words", words)):
        write_csv([rows.withColumns({c: plain_line(c) for c, t in rows.dtypes if t == "string"})], f"{path}/{name}")
    page = "\n".join(index_page(index.select(*LINE).orderBy("pair_id", "model", "example_id").toLocalIterator()))
    index.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index.md")


def insights(overall: DataFrame, pairs: DataFrame, baseline: str) -> list[str]:
    """Findings as markdown lines.

    overall: a row an arm (arm, family, windows, p_z, rouge, geomean, support, nll, extractable); pairs: arm, delta
    (mean log10 of the geometric mean against the baseline's). Best and closest arms: ties go to the first name.
    """
    lines = ["# Findings"]
    for r in overall.filter("family = 'ltr'").orderBy("arm").toLocalIterator():
        lines.append(f"- {r.arm}: mean p_z {r.p_z:.6g}, ROUGE-L {r.rouge:.4f}, {r.extractable} of {r.windows} windows extractable ({1e4 * r.extractable / r.windows:.1f} per 10k).")
    native = overall.filter("family = 'native'")
    best = native.agg(
        *(F.min(F.struct((sign * F.col(c)).alias("v"), "arm"))["arm"].alias(c) for c, sign in (("geomean", -1), ("support", -1), ("nll", 1))),
        F.max(F.when(F.col("arm") == baseline, F.col("support"))).alias("base_support"),
    ).first()
    if best.geomean is None:
        return lines
    lines.append(f"- Best split by geometric mean: {best.geomean}; by support: {best.support}; by NLL: {best.nll}.")
    if best.base_support is not None:
        for r in native.filter(F.col("arm") != baseline).orderBy("arm").toLocalIterator():
            lines.append(f"- {r.arm}: support {100 * (r.support - best.base_support):+.2f} points against {baseline}.")
    close = pairs.filter(F.col("arm") != baseline).agg(F.min(F.struct(F.abs("delta").alias("gap"), "arm", "delta")).alias("c")).first().c
    if close is not None:
        lines.append(f"- Closest to {baseline}: {close.arm}, mean log10 {close.delta:+.4f}.")
    return lines
