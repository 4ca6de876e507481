"""Kernels over arrays of logits, probabilities and vectors, as built-in higher-order functions.

A value that every element needs (a maximum, a sum) is bound once, by ``bound``, instead of being worked out anew for each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def average(a: Column) -> Column:
    """Mean; NaN of an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(float("nan")))


def logsumexp(a: Column) -> Column:
    found = bound(F.array_max(a), lambda m: m + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m))))
    return F.when(F.size(a) > 0, found).otherwise(F.lit(float("-inf")))


def softmax(a: Column, tau: float = 1.0) -> Column:
    def shares(m: Column) -> Column:
        e = F.transform(a, lambda x: F.exp((x - m) / tau))
        return bound(F.struct(e.alias("e"), total(e).alias("s")), lambda b: F.transform(b["e"], lambda x: x / b["s"]))
    return bound(F.array_max(a), shares)


def _safe(x: Column) -> Column:
    return F.greatest(x, F.lit(TINY))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: _safe(x) * F.log(_safe(x))))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: _safe(a) * (F.log(_safe(a)) - F.log(_safe(b)))))


def js(p: Column, q: Column) -> Column:
    def half(a: Column, b: Column) -> Column:
        m = (_safe(a) + _safe(b)) / 2
        return 0.5 * (_safe(a) * F.log(_safe(a) / m) + _safe(b) * F.log(_safe(b) / m))
    return total(F.zip_with(p, q, half))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def top_indices(a: Column, k: int) -> Column:
    """Places (from 0) of the k largest, ties to the smaller place."""
    tagged = F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda t: t["i"])


def gather(a: Column, idx: Column) -> Column:
    return F.transform(F.filter(idx, lambda i: (i >= 0) & (i < F.size(a))), lambda i: F.get(a, i))


def renormalised(p: Column) -> Column:
    return bound(F.greatest(total(p), F.lit(TINY)), lambda s: F.transform(p, lambda x: x / s))


def top_js(p: Column, q: Column, k: int) -> Column:
    """JS of both, limited to the k largest places of p; null where there are fewer than k + 1."""
    idx = top_indices(p, k)
    return F.when(F.size(p) > k, js(renormalised(gather(p, idx)), renormalised(gather(q, idx))))


def margin(logits: Column, yes: Column, no: Column) -> Column:
    return logsumexp(gather(logits, yes)) - logsumexp(gather(logits, no))


def mean_logprob(lp: Column, idx: Column) -> Column:
    """Mean of the chosen token log-probabilities; 0 of none."""
    picked = gather(lp, idx)
    return F.when(F.size(picked) > 0, total(picked) / F.size(picked)).otherwise(0.0)


def mixed(js_value: Column, entropy_gain: Column, lam: float) -> Column:
    return js_value + lam * F.greatest(F.lit(0.0), entropy_gain)


def replaced(seq: Column, targets: Column, mode: str, around: Column | None = None) -> Column:
    """Vectors of ``seq`` at ``targets`` set to zero, or to the mean of those at ``around`` that are in its range, of all where none is. (Noise: ``vectors.noised``.)"""
    if mode not in ("zero", "mean"):
        raise ValueError("mode must be zero or mean")
    zero = F.transform(F.get(seq, F.lit(0)), lambda x: x * 0.0)
    value = zero
    if mode == "mean":
        near = gather(seq, around)
        picked = F.when(F.size(near) > 0, near).otherwise(seq)
        value = bound(picked, lambda own: F.transform(F.aggregate(own, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / F.size(own)))
    return bound(value, lambda own: F.transform(seq, lambda v, i: F.when(F.array_contains(targets, i), own).otherwise(v)))


def abs_delta(a: Column, b: Column) -> Column:
    """struct(mean, max) of the absolute differences."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.struct(average(d).alias("mean"), F.array_max(d).alias("max"))


def span_reduced(values: Column, mode: str) -> Column:
    """One figure of a span's: mean or max over more than one place; else (single, or one place) the sum; 0 of none."""
    many = {"mean": total(values) / F.size(values), "max": F.array_max(values)}.get(mode)
    out = total(values) if many is None else F.when(F.size(values) > 1, many).otherwise(total(values))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, out).otherwise(0.0)


def mean_vector(vectors: Column) -> Column:
    """Componentwise mean; null of none."""
    def summed(own: Column) -> Column:
        zero = F.transform(F.get(own, F.lit(0)), lambda x: x * 0.0)
        return F.transform(F.aggregate(own, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / F.size(own))
    return F.when(F.size(vectors) > 0, bound(vectors, summed))


def state_distances(a: Column, b: Column, targets: Column, prompt_length: Column) -> Column:
    """struct of cosine and L2 distances of two sequences of vectors: means at the targets that are in range (null of none), at the prompt's last place, and at the last."""
    def pair(x: Column, y: Column, name: str) -> list[Column]:
        both = x.isNotNull() & y.isNotNull()
        return [F.when(both, cosine_distance(x, y)).alias(f"{name}_cosine"), F.when(both, l2_distance(x, y)).alias(f"{name}_l2")]
    last = F.size(a) - 1
    at = {"tgt": (mean_vector(gather(a, targets)), mean_vector(gather(b, targets))), "prompt_last": tuple(F.get(v, F.least(prompt_length - 1, last)) for v in (a, b)), "seq_last": tuple(F.get(v, last) for v in (a, b))}
    fields = F.struct(*[v.alias(f"{n}_{i}") for n, both in at.items() for i, v in enumerate(both)])
    return bound(fields, lambda f: F.struct(*[c for n in at for c in pair(f[f"{n}_0"], f[f"{n}_1"], n)]))
