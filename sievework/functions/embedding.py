"""Embedding: a protocol for models, a deterministic default, and an Arrow iterator around either."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY = "task: search result | query: {}"
CODE_QUERY = "task: code retrieval | query: {}"
BATCH = 16


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of hashed words and letter trigrams: no model, the same on every machine."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
                    code = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    row[code % self.dimensions] += 1 if code >> 63 else -1
            row /= max(float(np.linalg.norm(row)), 1e-9)
        return out


def document_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), text)


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """rows with vec and error. The model is made once for each task; a batch that fails is tried item by item."""
    schema = rows.schema.simpleString()[7:-1] + ", vec array<float>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            vectors: list[np.ndarray | None] = []
            errors: list[str | None] = []
            texts = frame[text].fillna("").tolist()
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                try:
                    vectors += list(model.embed(some))
                    errors += [None] * len(some)
                except Exception:
                    for one in some:
                        try:
                            vectors.append(model.embed([one])[0])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e)[:200])
            yield frame.assign(vec=vectors, error=errors)

    return rows.mapInPandas(run, schema)
