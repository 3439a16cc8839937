"""Deterministic embedding from SHA-256 digests, for runs without a model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_DIGEST = 32


def hash_embedding(text: Column, dimensions: int = 1536) -> Column:
    """Bytes of SHA-256("0:text"), SHA-256("1:text"), ... scaled from 0..255 to -1..1."""
    digests = F.transform(
        F.sequence(F.lit(0), F.lit(math.ceil(dimensions / BYTES_PER_DIGEST) - 1)),
        # One character per byte, so that ascii() gives the byte value back.
        lambda counter: F.decode(
            F.unhex(F.sha2(F.concat(counter.cast("string"), F.lit(":"), text), 256)), "ISO-8859-1"
        ),
    )
    values = F.flatten(
        F.transform(
            digests,
            lambda digest: F.transform(
                F.sequence(F.lit(1), F.lit(BYTES_PER_DIGEST)),
                lambda at: F.ascii(F.substr(digest, at, F.lit(1))) / F.lit(255.0) * F.lit(2.0) - F.lit(1.0),
            ),
        )
    )
    return F.slice(values, 1, dimensions).cast("array<float>")


def embedding_config(provider: str, model: str, dimensions: int) -> Column:
    """Fingerprint stored with a corpus, compared before a dense search."""
    return F.struct(
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(dimensions).alias("dimensions"),
    )
