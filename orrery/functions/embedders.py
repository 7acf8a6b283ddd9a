"""Embedders: what takes texts to vectors, a registry that loads each once a worker, and a made one without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from orrery.scratch import ship

EMBEDDED = "vector array<float>, truncated boolean"


def direction(label: str, dim: int) -> np.ndarray:
    """A label's direction: the words of its SHAKE-256 digest, each between -0.5 and 0.5."""
    words = np.frombuffer(hashlib.shake_256(label.encode()).digest(4 * dim), "<u4")
    return words / 2.0**32 - 0.5


class Registry:
    """Embedders by name, each made when first asked for; one that could not be made is tried again, and two threads make one."""

    def __init__(self, factories: dict[str, Callable]):
        self.factories = factories
        self.made: dict[str, object] = {}
        self.locks = {name: Lock() for name in factories}

    def get(self, name: str):
        if name not in self.factories:
            raise LookupError(f"{name!r} is no embedder")
        with self.locks[name]:
            if name not in self.made:
                self.made[name] = self.factories[name]()
            return self.made[name]


class MadeEmbedder:
    """Embeds each label in a direction of its own, the same wherever and whenever."""

    def __init__(self, dim: int, *, takes_text: bool = True):
        self.dim, self.takes_text = dim, takes_text

    def embed_text(self, texts: list[str]) -> np.ndarray:
        if not self.takes_text:
            raise ValueError("this model takes no text")
        return self.units([direction(t, self.dim) for t in texts])

    def embed_images(self, contents: list[bytes]) -> np.ndarray:
        """A picture's label is drawn from its bytes."""
        return self.units([direction(hashlib.shake_256(c).hexdigest(16), self.dim) for c in contents])

    def units(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros((0, self.dim), np.float32)
        whole = np.stack(rows)
        norms = np.linalg.norm(whole, axis=1, keepdims=True)
        if whole.shape[1] != self.dim or not norms.all():
            raise ValueError("vectors must have the model's width and a direction")
        return (whole / norms).astype(np.float32)


def embed(raw: Column, dim: int, *, images: bool = False, batch: int = 256) -> Column:
    """Vectors of a column of texts (or pictures' bytes) as struct(vector, truncated), in batches that keep the rows' order; nulls give null.

    The embedder is made once for all batches of a task.
    """
    ship(SparkSession.active())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = MadeEmbedder(dim)
        for part in parts:
            vectors: list = [None] * len(part)
            given = [i for i, v in enumerate(part) if v is not None]
            for at in range(0, len(given), batch):
                some = given[at : at + batch]
                values = [part.iloc[i] for i in some]
                for i, v in zip(some, made.embed_images(values) if images else made.embed_text(values), strict=True):
                    vectors[i] = v.tolist()
            yield pd.DataFrame({"vector": vectors, "truncated": [None if v is None else False for v in vectors]})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # as types, not as text
    return F.pandas_udf(run, EMBEDDED)(raw)


def register(models: dict[str, int], widths: dict[str, int]) -> Registry:
    """A registry of made embedders; refuses a model whose width is not the declared one."""
    for name, dim in models.items():
        if widths.get(name) != dim:
            raise ValueError(f"{name!r} has width {dim}, declared is {widths.get(name)}")
    return Registry({name: (lambda d=dim: MadeEmbedder(d)) for name, dim in models.items()})
