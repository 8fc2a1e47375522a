"""Tokenizers as plugins: an object with encode, decode and an end id, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Names of a row's token ids, the first that is there counts.
FIELDS = ("tokens", "ids", "input_ids", "token_ids")


class Tokenizer(Protocol):
    end: int

    def encode(self, text: str) -> Sequence[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...


class Bytes:
    """The built-in one: UTF-8 bytes, and 256 as the end."""

    end = 256

    def encode(self, text: str) -> list[int]:
        return list(text.encode("utf-8", "surrogatepass"))

    def decode(self, ids: Sequence[int]) -> str:
        """Specials stay, as their names."""
        return "<|end|>".join(bytes(x).decode("utf-8", "replace") for x in _split(ids, self.end))

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """encode() of a batch, from its buffer of bytes."""
        whole = pc.fill_null(texts, "").cast(pa.binary())
        data = np.frombuffer(b"" if whole.buffers()[2] is None else whole.buffers()[2], np.uint8)
        ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int32)
        return lists(data[ends[0] : ends[-1]].astype(np.int32), ends - ends[0], texts)

    def decode_all(self, ids: pa.Array) -> pa.Array | None:
        """decode() of a batch of whole texts; None if it holds an end or what is no text."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not (flat.min() >= 0 and flat.max() < 256):
            return None
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy()))).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(np.uint8))])
        try:
            return pc.if_else(ids.is_valid(), made.cast(pa.string()), None)
        except pa.ArrowInvalid:
            return None


def _split(ids: Sequence[int], end: int) -> Iterator[list[int]]:
    part: list[int] = []
    for x in ids:
        if x == end:
            yield part
            part = []
        else:
            part.append(int(x))
    yield part


BYTES = Bytes()
_loaded: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """A model or tokenizer of a worker: loaded when first asked for, then kept."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def lists(values: np.ndarray, ends: np.ndarray, of: pa.Array) -> pa.Array:
    """Lists of values, cut at ends (from 0 on); null where of is null."""
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
    return pc.if_else(of.is_valid(), found, None) if of.null_count else found


def encode(tokenizer: Tokenizer) -> Callable[..., Column]:
    """A column function: text to ids, without special ids; null stays null.

    A tokenizer may have encode_all and decode_all, which take a batch at once; others are asked text by text. Either
    way a batch's ids are numbers in one buffer, not Python objects.
    """

    def run(texts: pa.Array) -> pa.Array:
        if hasattr(tokenizer, "encode_all"):
            return tokenizer.encode_all(texts)
        ids = [np.asarray([] if x is None else tokenizer.encode(x), np.int32) for x in (t.as_py() for t in texts)]
        return lists(np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)]), texts)

    return F.arrow_udf(run, ArrayType(IntegerType()))


def decode(tokenizer: Tokenizer) -> Callable[..., Column]:
    def run(ids: pa.Array) -> pa.Array:
        found = tokenizer.decode_all(ids) if hasattr(tokenizer, "decode_all") else None
        return pa.array([tokenizer.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids], pa.string()) if found is None else found

    return F.arrow_udf(run, StringType())


def token_field(columns: list[str]) -> Column:
    """The ids of a row, from whichever of FIELDS it has."""
    if not (found := [c for c in FIELDS if c in columns]):
        raise ValueError(f"no column of {', '.join(FIELDS)}")
    return F.coalesce(*(F.col(c) for c in found))


def check_specials(ids: dict[str, int | None], wanted: dict[str, int]) -> None:
    """An error unless every special token has the id that the layouts count on."""
    wrong = [f"{k} is {ids.get(k)}, not {v}" for k, v in wanted.items() if ids.get(k) != v]
    if wrong:
        raise ValueError("special ids: " + "; ".join(wrong))


def pad_token(configured: str | None, specials: Sequence[str], vocabulary: Sequence[str] | dict) -> tuple[str | None, str]:
    """The token that pads, and why: one that is set; a special with "pad" in its name; the first special; a reserved one."""
    if configured is not None:
        return configured, "already-configured"
    named = [x for x in specials if x]
    for x in named:
        if "pad" in x.lower():
            return x, "matched-substring"
    if named:
        return named[0], "fallback-first"
    reserved = "<|reserved_special_token_3|>"  # fixed value
    return (reserved, "fallback-reserved") if reserved in vocabulary else (None, "none-available")
