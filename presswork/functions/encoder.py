"""Text encoding in Arrow batches with a pluggable, per-worker cached encoder.

An encoder is any object with ``encode(list[str]) -> matrix``; an ``EncoderSpec`` says how
to build one and is its identity: a worker keeps one encoder per spec, so two specs never
share one. The default is a hashed character n-gram encoder: repeatable, no model file, and
no claim to match a neural model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Vector size and texts per encoder call.
DIMENSIONS = 768
BATCH_SIZE = 32

_CACHE: dict[str, object] = {}


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Signed counts of character 3- to 5-grams hashed into a fixed number of dimensions."""

    def __init__(self, dimensions: int = DIMENSIONS, sizes: tuple[int, ...] = (3, 4, 5)):
        self.dimensions, self.sizes = dimensions, sizes

    def encode(self, texts: list[str]) -> np.ndarray:
        padded = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
        total = np.zeros(len(texts) * self.dimensions)
        for size in self.sizes:
            n = len(codes) - size + 1
            if n <= 0:
                continue
            inside = rows[:n] == rows[size - 1 :]  # a gram does not run into the next text
            grams = np.full(n, size, dtype=np.uint64)
            for i in range(size):
                grams = (grams ^ codes[i : i + n]) * np.uint64(0x100000001B3)
                grams ^= grams >> np.uint64(29)
            grams, owner = grams[inside], rows[:n][inside]
            slots = owner * self.dimensions + (grams % np.uint64(self.dimensions)).astype(np.int64)
            signs = np.where((grams >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)
            total += np.bincount(slots, weights=signs, minlength=len(total))
        return total.reshape(len(texts), self.dimensions)


class LetterCounts:
    """How often characters of each residue class occur: plain enough to be restated anywhere."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) % self.dimensions
            row += np.bincount(codes, minlength=self.dimensions)
        return out


class EncoderSpec:
    """A factory and its identity, made from what the factory is rather than given by name.

    Specs of equal pickled factories are equal, in every worker and session.
    """

    def __init__(self, factory: Callable[[], Encoder]):
        self.factory = factory
        self.key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


HASHED = EncoderSpec(HashedNgrams)


def cached(spec: EncoderSpec) -> Encoder:
    """The worker's encoder of that spec, built on first use and kept across tasks."""
    if spec.key not in _CACHE:
        _CACHE[spec.key] = spec.factory()
    return _CACHE[spec.key]


def unit_float32(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0).astype(np.float32)


def embed(
    df: DataFrame,
    text_column: str,
    out_column: str = "embedding",
    spec: EncoderSpec = HASHED,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add unit-length ``array<float>`` embeddings of a text column; rows are not moved.

    Chunks and questions must use the same ``spec``.
    """

    def run(batches):
        from presswork.functions.encoder import cached, unit_float32

        encoder = cached(spec)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            vectors = [
                unit_float32(np.asarray(encoder.encode(texts[i : i + batch_size]), dtype=float))
                for i in range(0, len(texts), batch_size)
            ]
            matrix = np.concatenate(vectors) if vectors else np.zeros((0, 1), np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * matrix.shape[1]
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], [*batch.schema.names, out_column]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out_column}` array<float>")
