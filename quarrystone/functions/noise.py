"""Random columns and noise.  With a seed, reruns over the same partitions agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.col import dbl, to_col


def _u(seed: int | None) -> Column:
    return F.rand(seed) if seed is not None else F.rand()


def _z(seed: int | None) -> Column:
    return F.randn(seed) if seed is not None else F.randn()


def random(lower: float = 0.0, upper: float = 1.0, seed: int | None = None) -> Column:
    return _u(seed) * (upper - lower) + lower


def random_int(lower: int, upper: int, seed: int | None = None) -> Column:
    return F.floor(_u(seed) * (upper - lower) + lower).cast("int")


def random_exp(lambda_: float, seed: int | None = None) -> Column:
    return -F.log1p(-_u(seed)) / lambda_


def random_normal(mean: float, std: float, seed: int | None = None) -> Column:
    return mean + std * _z(seed)


def random_null(x, pct: float, seed: int | None = None) -> Column:
    return F.when(_u(seed) >= pct, to_col(x))


def perturb(x, epsilon: float = 1e-5, positive: bool = False, seed: int | None = None) -> Column:
    lo, hi = (0.0, epsilon) if positive else (-epsilon / 2, epsilon / 2)
    return dbl(x) + _u(seed) * (hi - lo) + lo


def jitter(x, std: float = 1.0, seed: int | None = None) -> Column:
    return dbl(x) + std * _z(seed)


def add_noise(x, noise_type: str = "gaussian", **kwargs) -> Column:
    return jitter(x, **kwargs) if noise_type == "gaussian" else perturb(x, **kwargs)


def _drawer(u: pd.Series) -> np.random.Generator:
    """One generator for a batch, seeded by its draws: reruns over the same batches agree."""
    return np.random.default_rng([len(u), *(int(x * 2**53) for x in u.iloc[[0, -1]])] if len(u) else 0)


#: Characters that a batch draws at once.
DRAWN = 1 << 22


def random_str(min_size: int, max_size: int, seed: int | None = None) -> Column:
    """Letters and digits; the length is drawn too."""
    u, v = _u(seed), _u(None if seed is None else seed + 1)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import string

        chars = np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8)
        rng, out = _drawer(b), []
        sizes = min_size + (a.to_numpy() * (max_size - min_size + 1)).astype(np.int64)
        step = max(1, DRAWN // max(max_size, 1))
        for i in range(0, len(sizes), step):
            ends = np.cumsum(sizes[i : i + step])
            text = chars[rng.integers(0, len(chars), int(ends[-1]))].tobytes().decode()
            out += [text[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pd.Series(out, dtype=object)

    return run(u, v)


def random_binomial(n: int, p: float, seed: int | None = None) -> Column:
    @F.pandas_udf("int")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series(_drawer(a).binomial(n, p, len(a)), dtype="int32")

    return run(_u(seed))
