"""Mixing indexed corpora: where a mode's parts lie, its sources copied to numbered shards, the shards put together."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession

from . import tokenindex as T

#: A mode's web folder, book folder and output; any other mode is no_fim.
MODES = {
    "fim": ("fineweb_100BT_llama_fim", "4096_tokens_with_fim", "combined_fim"),
    "fim_v2": ("fineweb_100BT_llama_fim", "4096_tokens_with_fim_v2", "combined_fim_v2"),
    "hybrid": ("fineweb_100BT_llama_fim", "4096_tokens_hybrid", "combined_hybrid"),
    "no_fim": ("fineweb_100BT_llama_no_fim", "4096_tokens_no_fim", "combined_no_fim"),
}
#: Presets of the stages that lay sequences out: share with the middle last, and the cap.
PRESETS = {"web_fim": (0.5, 16380), "web_no_fim": (0.0, 16383), "book_fim": (1.0, 4096)}


def layout(root: str, mode: str, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """web (a glob), book (a prefix), shards (a folder), out (a prefix); settings override them."""
    env = os.environ if env is None else env
    web, book, out = MODES.get(mode.lower(), MODES["no_fim"])
    return {
        "web": env.get("MIX_FINEWEB_GLOB", f"{root}/fineweb/{web}/*.bin"), "book": env.get("MIX_GUTENBERG_PREFIX", f"{root}/gutenberg/{book}/tokens"),
        "shards": env.get("MIX_SHARD_DIR", f"{root}/{out}_shards"), "out": env.get("MIX_OUTPUT_PREFIX", f"{root}/{out}"),
    }


def _files(pattern: str) -> list[str]:
    """Files of the pattern's folder that end as it does, in the order of names."""
    system, folder = T.located(os.path.dirname(pattern))
    ending = os.path.basename(pattern).removeprefix("*")
    head = os.path.dirname(pattern)
    return sorted(f"{head}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.base_name.endswith(ending))


def sources(where: dict[str, str]) -> list[str]:
    """The book corpus, then the web files; those of which either file is missing are left out."""
    return [p for p in [where["book"], *(x.removesuffix(".bin") for x in _files(where["web"]))] if T.there(f"{p}.bin") and T.there(f"{p}.idx")]


def copy_shards(spark: SparkSession, where: dict[str, str]) -> list[str]:
    """Source i becomes shard_i, copied by executors, byte for byte; each is written beside and renamed."""
    found = sources(where)
    folder = where["shards"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, prefix in zip(frame.number, frame.prefix, strict=True):
                T.Index(prefix)  # an index that can't be read is not copied
                for kind in ("bin", "idx"):
                    (a, x), (b, y) = T.located(f"{prefix}.{kind}"), T.located(f"{folder}/shard_{number}.{kind}")
                    b.create_dir(os.path.dirname(y), recursive=True)
                    fs.copy_files(x, f"{y}.part-{os.getpid()}", source_filesystem=a, destination_filesystem=b)
                    b.move(f"{y}.part-{os.getpid()}", y)
                yield pd.DataFrame({"number": [number]})

    if found:
        rows = spark.createDataFrame(list(enumerate(found)), "number int, prefix string").repartition(len(found), "number")
        rows.mapInPandas(run, "number int").count()
    return [f"{folder}/shard_{i}" for i in range(len(found))]


def merge_shards(spark: SparkSession, where: dict[str, str]) -> str:
    """All shards of the folder in the order of their names (shard_10 before shard_2) as one index; an error without any."""
    found = [x.removesuffix(".bin") for x in _files(f"{where['shards']}/*.bin") if os.path.basename(x).startswith("shard_")]
    if not found:
        raise RuntimeError(f"no shards in {where['shards']}")
    T.merge(spark, found, where["out"])
    return where["out"]


def mix(spark: SparkSession, root: str, mode: str, env: Mapping[str, str] | None = None) -> str:
    """Map, then reduce: ids stay as they are."""
    where = layout(root, mode, env)
    copy_shards(spark, where)
    return merge_shards(spark, where)
