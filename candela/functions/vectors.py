"""Kernels over long vectors, such as logits over a vocabulary, on Arrow buffers: selection without a sort, one pass a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.arrays import TINY, bound, gather, total
from candela.functions.geometry import unit_hash

# Sizes of the vocabulary's tops that are compared.
TOPS = (10, 50, 100, 500)


def top_places(a: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of ``a``, ascending; ties to the smaller place. Linear in the length: what is above the k-th value, then what equals it."""
    border = np.partition(a, len(a) - k)[len(a) - k]
    above = np.flatnonzero(a > border)
    return np.sort(np.concatenate([above, np.flatnonzero(a == border)[: k - len(above)]]))


def _js(p: np.ndarray, q: np.ndarray) -> float:
    p, q = np.maximum(p, TINY), np.maximum(q, TINY)
    m = (p + q) / 2
    return float(0.5 * (p * np.log(p / m) + q * np.log(q / m)).sum())


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max())
    return e / e.sum()


def _tops(ks: tuple[int, ...]):
    names = [f"{what}_{k}" for k in ks for what in ("js", "cos", "mass")]

    def run(batches):
        for batch in batches:
            sides = []
            for name in ("_a", "_b"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])))
            out: dict[str, list] = {n: [] for n in names}
            for i in range(batch.num_rows):
                a, b = (v[cut[i]: cut[i + 1]] for v, cut in sides)
                p, q = (_softmax(a), _softmax(b)) if len(a) and len(a) == len(b) else (a, b)
                for k in ks:
                    js = cos = mass = None
                    if len(a) == len(b) and k < len(a):
                        at = top_places(a, k)
                        mass = float(p[at].sum())
                        js = _js(p[at] / max(mass, TINY), q[at] / max(float(q[at].sum()), TINY))
                        cos = 1.0 - float(a[at] @ b[at]) / max(float(np.sqrt(a[at] @ a[at]) * np.sqrt(b[at] @ b[at])), 1e-8)
                    for what, value in (("js", js), ("cos", cos), ("mass", mass)):
                        out[f"{what}_{k}"].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[n], pa.float64()) for n in names]], names=[batch.schema.names[0], *names])
    return run


def top_divergences(df: DataFrame, key: str, original: str, replaced: str, ks: tuple[int, ...] = TOPS) -> DataFrame:
    """For each k, over the k largest original logits: ``js_k`` of the renormalised probabilities, ``cos_k``, the distance of the logits, and ``mass_k``, the original probability there.

    Null where the vocabulary has no more than k entries, or the two lengths differ; null logits are no numbers.
    """
    nan = F.lit(float("nan"))
    rows = df.where(F.col(original).isNotNull() & F.col(replaced).isNotNull()).select(key, *[F.transform(c, lambda x: F.coalesce(x.cast("double"), nan)).alias(n) for c, n in ((original, "_a"), (replaced, "_b"))])
    schema = ", ".join([f"{key} {df.schema[key].dataType.simpleString()}", *[f"{what}_{k} double" for k in ks for what in ("js", "cos", "mass")]])
    return rows.mapInArrow(_tops(tuple(ks)), schema)


# -- noise ---------------------------------------------------------------------------------------

def normal(*key: Column) -> Column:
    """A number of the standard normal distribution that the key picks: two uniform ones by hash, turned by Box and Muller's formula; the same wherever it is worked out."""
    name = F.concat_ws(":", *[k.cast("string") for k in key])
    u = F.greatest(unit_hash(F.concat(name, F.lit(":u"))), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * np.pi) * unit_hash(F.concat(name, F.lit(":v"))))


def noised(seq: Column, targets: Column, key: Column, seed: int = 0) -> Column:
    """Vectors of ``seq`` at ``targets`` in its range as noise with the standard deviation of what they hold (n - 1; at least a millionth), drawn by seed, row key, place and component."""
    held = F.flatten(gather(seq, F.array_distinct(targets)))

    def spread(mean: Column) -> Column:
        return F.sqrt(total(F.transform(held, lambda x: (x - mean) * (x - mean))) / (F.size(held) - 1))
    sd = F.when(F.size(held) > 1, F.greatest(bound(total(held) / F.size(held), spread), F.lit(1e-6))).otherwise(F.lit(1e-6))
    return bound(sd, lambda s: F.transform(seq, lambda v, i: F.when(F.array_contains(targets, i), F.transform(v, lambda x, j: s * normal(F.lit(seed), key, i, j))).otherwise(v)))
