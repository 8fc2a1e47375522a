"""Training sequences from token arrays: left to right, or with the middle last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rng import split_draws
from ..sources.mix import PRESETS

#: Share of documents laid out with the middle last where none is given.
SHARES = {"ltr_clean": 0.0, "fim_hybrid": 0.5, "fim": 1.0}


def key_of(excerpt: str | None = None, replica: str | None = None, row: str = "seq_id") -> Column:
    """The key of a row's draws: excerpt, excerpt and replica, or the place in the source (skipped rows count)."""
    if excerpt is None:
        return F.concat(F.lit("bin:"), F.col(row))
    return F.col(excerpt) if replica is None else F.when(F.col(replica).isNull(), F.col(excerpt)).otherwise(F.concat(F.col(excerpt), F.lit(":replica:"), F.col(replica)))


def lay_out(df: DataFrame, key: Column, mode: str = "fim_hybrid", share: float | None = None, seed: int = 42, least: int = 50, cap: int | None = None, even: bool = False) -> DataFrame:
    """Adds laid_out and is_fim; drops rows with fewer than least ids after stripping.

    Draws by key: the coin first, then the cuts; left to right draws nothing.
    """
    share = min(max(SHARES.get(mode, 1.0) if share is None else share, 0.0), 1.0)
    df = df.withColumn("tokens", A.strip(F.col("tokens"))).filter(F.size("tokens") >= least).withColumn("tokens", A.cap(F.col("tokens"), cap))
    t = F.col("tokens")
    if share == 0.0:
        return df.withColumn("laid_out", A.one_eos(A.clean_ltr(t))).withColumn("is_fim", F.lit(False))
    df = df.withColumn("_d", split_draws(F.lit(str(seed)), key, F.size("tokens")))
    left, middle = A.even_cuts(t) if even else (F.col("_d.left_end"), F.col("_d.middle_end"))
    df = df.withColumn("is_fim", F.col("_d.coin") <= share)
    return df.withColumn("laid_out", A.one_eos(F.when(F.col("is_fim"), A.fim(t, left, middle)).otherwise(A.clean_ltr(t)))).drop("_d")


def by_preset(df: DataFrame, key: Column, preset: str, seed: int = 42) -> DataFrame:
    """lay_out() with a stage's share and cap. Caps apply after rows are chosen, so presets of one source keep the same rows."""
    if preset not in PRESETS:
        raise ValueError(f"no preset is called {preset}")
    share, cap = PRESETS[preset]
    return lay_out(df, key, share=share, cap=cap, seed=seed)


def epoch_tokens(tokens: int, batch: int, length: int) -> int:
    """Tokens rounded up to whole batches."""
    step = batch * length
    return -(-tokens // step) * step
