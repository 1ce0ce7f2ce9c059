"""Batch text encoding with a pluggable encoder.

``encode_texts`` runs any ``encoder(list[str]) -> ndarray[n, d]`` over Arrow batches
of ``batch_size`` texts with ``mapInPandas`` (the batch size bounds encoder memory,
as the reference's GPU batches do).  Without an encoder the default is JVM-side:
tokens -> feature hashing -> L2 normalisation, no Python at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from chorus.functions import text as tx
from chorus.functions import vectors as vf

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in encoder (no model weights are available): signed
    feature hashing of lower-cased word tokens, L2-normalised."""
    import re

    import xxhash

    word = re.compile(r"\w\w+")

    def enc(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            for w in word.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1.0 if (h >> 63) == 0 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

    return enc


def encode_texts(df: DataFrame, id_col: str, text: str, encoder: Encoder | None = None, batch_size: int = 150, dim: int = 64, out: str = "vec") -> DataFrame:
    """(id, vec array<double>) for every row."""
    if encoder is None:
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        hashed = tf.transform(df.select(id_col, tx.tokenise(text).alias("_tok")))
        return hashed.select(id_col, vf.l2_normalise(vector_to_array("_tf")).alias(out))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                vecs = encoder(part[text].tolist())
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), out: list(vecs.astype(np.float64))})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInPandas(run, f"{id_col} {id_type}, {out} array<double>")
