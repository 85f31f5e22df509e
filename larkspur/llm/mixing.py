"""Mixing to target weights with soft membership.

A classifier learned from the labelled table predicts how far each document belongs to each domain: a softmax over the
mean of its words' hashed indicators. Documents' token counts times these posteriors add up to a domain's expected
tokens. Rates r >= 0, one for each document, minimise

    |sum_d r_d w_d p_d - target|^2 / 2 + ridge / 2 * sum_d w_d (r_d - 1)^2,   w_d = tokens_d / all tokens,

which has one solution: r_d = max(0, 1 - p_d . gap / ridge), where gap is a number a domain, what is left between the
sums and the targets. Newton steps in the gaps, over the rows whose rate isn't 0, find it: each round is a pass over the
rows that brings sums of a few numbers a domain and pair of domains to the driver. Rounds end when the projected gradient
is ``Fit.optimal`` at most, in shares of all tokens; if ``Fit.solve_rounds`` don't get there, that is an error. A gap
over ``Fit.close`` that the solution leaves, as the ridge holds rates of rare domains back or documents can't meet the
targets, is a warning with its size.

``materialise`` turns rates into rows: the whole part of a rate, and one more row with the probability of its fraction,
decided by a hash of the id.

Fitting reads a bounded sample of labelled rows, ``Fit.rows``, in the order of a hash of the id; posteriors, counts and
rates cover all rows. Null text is empty, has no tokens, the prior's posteriors, and a rate like any. Rows with a null
domain don't train. With no labelled rows there is one domain, null. Repeated rows get the same rate. Extra columns
aren't read, and ``materialise`` keeps them. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.arrow import map_arrow, map_batches, schema_of, utf8
from larkspur.llm.encoding import encoder
from larkspur.llm.scratch import Scratch
from larkspur.llm.words import U, hashed_texts


@dataclass(frozen=True)
class Fit:
    rows: int = 4000
    buckets: int = 2048
    rounds: int = 200
    step: float = 20.0
    ridge: float = 1e-4
    solve_rounds: int = 60
    solve_ridge: float = 1e-5
    close: float = 1e-4
    optimal: float = 1e-6


def indicators(words: np.ndarray, buckets: int) -> np.ndarray:
    if not len(words):
        return np.zeros(buckets, np.float32)
    return (np.bincount((words & U(buckets - 1)).astype(np.int64), minlength=buckets) / len(words)).astype(np.float32)


@dataclass
class Domains:
    names: list
    weights: np.ndarray | None = None  # (buckets, domains)
    bias: np.ndarray | None = None

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones((len(x), 1))
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, y: np.ndarray, names: list, fit: Fit) -> Domains:
    """Softmax regression by gradient descent with momentum."""
    one_hot = np.eye(len(names))[y]
    w, bias = np.zeros((x.shape[1], len(names))), np.log(one_hot.mean(0) + 1e-9)
    # rare buckets get steps as large as common ones
    scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-3)[:, None]
    pace, pace_b = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(fit.rounds):
        gap = Domains(names, w, bias).posteriors(x) - one_hot
        pace = 0.9 * pace - fit.step * 0.1 * (scale * (x.T @ gap) / len(x) + fit.ridge * w)
        pace_b = 0.9 * pace_b - 0.1 * gap.mean(0)
        w, bias = w + pace, bias + pace_b
    return Domains(names, w, bias)


def train(docs: DataFrame, labelled: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()) -> Domains:
    """A classifier of ``domain_col``, learned from the documents that ``labelled`` lists."""
    order = F.xxhash64(F.col("id"), F.lit(23))
    ids = labelled.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().orderBy(order, "id").limit(fit.rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("text"))
    sample = rows.filter("y IS NOT NULL").join(F.broadcast(ids), "id")  # at most fit.rows ids

    def of_batch(batch: pa.RecordBatch) -> dict:
        x = [indicators(w, fit.buckets).tobytes() for _, w in hashed_texts([t or b"" for t in utf8(batch.column(2))])]
        return {"id": batch.column(0).cast(pa.string()), "y": batch.column(1), "x": x}

    found = map_batches(sample.select("id", "y", "text"), of_batch, "id string, y string, x binary").collect()
    found.sort(key=lambda r: (r["id"], r["y"]))
    names = sorted({r["y"] for r in found})
    if len(names) < 2:
        return Domains(names or [None])
    return learn(np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64), np.array([names.index(r["y"]) for r in found]), names, fit)


def memberships(docs: DataFrame, domains: Domains, path: str, id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()) -> DataFrame:
    """``id_col``, n_tokens and posteriors (in the order of ``domains.names``) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        texts, encode = [t or b"" for t in utf8(batch.column(1))], encoder(path)
        p: list = []
        for s in range(0, len(texts), 512):
            x = np.array([indicators(w, fit.buckets) for _, w in hashed_texts(texts[s : s + 512])])
            p += domains.posteriors(x).tolist()
        return {"id": batch.column(0), "n_tokens": [len(encode(t.decode("utf-8", "replace"))) for t in texts], "posteriors": p}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of_batch, f"id {kind}, n_tokens bigint, posteriors array<double>").withColumnRenamed("id", id_col)


def rates_of(p: np.ndarray, gap: np.ndarray, step: float) -> np.ndarray:
    return np.maximum(0, 1 - step * (p @ gap))


#: Parts of a Newton step that a round tries at once; the least is under ridge over the largest curvature.
TRIED = 4.0 ** -np.arange(10)


def sums_at(w: np.ndarray, p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each of ``points`` (u, for rates max(0, 1 - p . u)) a row: sum w r^2 / 2, sums w r p, sums w p p' where r > 0."""
    out = []
    for u in points:
        r = rates_of(p, u, 1.0)
        out.append(np.concatenate([[(w * r * r).sum() / 2], (w * r) @ p, ((p * (w * (r > 0))[:, None]).T @ p).ravel()]))
    return np.array(out)


def newton(sums, targets: np.ndarray, fit: Fit) -> np.ndarray:
    """The gaps of the solution; ``sums`` gives ``sums_at`` over all rows."""
    k, ridge = len(targets), fit.solve_ridge
    points, off = np.zeros((1, k)), np.inf
    for _ in range(fit.solve_rounds):
        got = sums(points)
        value = got[:, 0] + points @ targets + ridge / 2 * (points**2).sum(1)
        slopes = targets + ridge * points - got[:, 1 : k + 1]
        # no component of the projected gradient of the rates is larger than the largest slope
        offs = np.abs(slopes).max(1)
        best = offs.argmin() if offs.min() <= fit.optimal else value.argmin()
        u, off = points[best], offs[best]
        if off <= fit.optimal:
            return ridge * u
        points = u - TRIED[:, None] * np.linalg.solve(got[best, k + 1 :].reshape(k, k) + ridge * np.eye(k), slopes[best])
    raise RuntimeError(f"rates are not optimal after {fit.solve_rounds} rounds: the projected gradient is {off:.2g}, over {fit.optimal:.2g}")


def solve(held: DataFrame, targets: np.ndarray, fit: Fit = Fit()) -> tuple[np.ndarray, float]:
    """(gap, step): what is left of each domain's share of all tokens over its target, and 1 / ridge."""
    k = len(targets)
    step = 1 / fit.solve_ridge
    total = held.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return np.zeros(k), step
    row = schema_of("at int, v double")
    arrow_row = to_arrow_schema(row)

    def sums(points: np.ndarray) -> np.ndarray:
        shape = (len(points), 1 + k + k * k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    out += sums_at(batch.column(0).to_numpy() / total, batch.column(1).flatten().to_numpy().reshape(-1, k), points)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], schema=arrow_row)

        got = np.zeros(shape)
        for r in map_arrow(held.select("n_tokens", "posteriors"), run, row).groupBy("at").agg(F.sum("v").alias("v")).collect():
            got.flat[r["at"]] = r["v"]
        return got

    gap = newton(sums, targets, fit)
    if np.abs(gap).max() > fit.close:
        warnings.warn(f"optimal rates leave a domain's share {np.abs(gap).max():.2g} of all tokens from its target", stacklevel=2)
    return gap, step


def with_rates(held: DataFrame, gap: np.ndarray, step: float, names: list, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, domain (the likeliest), posterior (its), n_tokens, rate."""
    kind = held.schema[id_col].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        p = batch.column(2).flatten().to_numpy().reshape(-1, len(names))
        best = p.argmax(1)
        return {"id": batch.column(0), "domain": [names[b] for b in best], "posterior": p[np.arange(len(p)), best], "n_tokens": batch.column(1), "rate": rates_of(p, gap, step)}

    made = map_batches(held.select(F.col(id_col).alias("id"), "n_tokens", "posteriors"), of_batch, f"id {kind}, domain string, posterior double, n_tokens bigint, rate double")
    return made.withColumnRenamed("id", id_col)


def shares(held: DataFrame, k: int) -> np.ndarray:
    """Each domain's expected share of all tokens, at rate 1."""
    got = held.agg(F.sum("n_tokens").alias("t"), *[F.sum(F.col("n_tokens") * F.element_at("posteriors", j + 1)).alias(f"s{j}") for j in range(k)]).first()
    return np.array([(got[f"s{j}"] or 0.0) / (got["t"] or 1) for j in range(k)])


def mix(docs: DataFrame, labelled: DataFrame, path: str, targets: dict[str, float] | float = 0.0, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()) -> DataFrame:
    """``id_col``, domain, posterior, n_tokens, rate of each row.

    ``targets``: a weight for each domain (others: 0), or a power that flattens the shares there are (1: as they are,
    0: all alike). Rates keep the sum of tokens.
    """
    domains = train(docs, labelled, domain_col, id_col, text_col, fit)
    names = domains.names
    with Scratch(docs.sparkSession) as s:
        held = s.write(memberships(docs, domains, path, id_col, text_col, fit))
        if isinstance(targets, dict):
            goal = np.array([float(targets.get(n, 0.0)) for n in names])
        else:
            goal = shares(held, len(names)) ** targets
        goal = goal / goal.sum() if goal.sum() else np.full(len(names), 1 / len(names))
        gap, step = solve(held, goal, fit)
        return s.keep(with_rates(held, gap, step, names, id_col))


def materialise(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """The rows of ``docs`` as often as their rates say; rates: ``id_col``, rate."""
    per_id = rates.groupBy(F.col(id_col).alias("_id")).agg(F.max("rate").alias("_rate"))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    joined = docs.join(per_id, docs[id_col].eqNullSafe(per_id["_id"]))
    times = F.floor("_rate").cast("int") + (chance < F.col("_rate") - F.floor("_rate")).cast("int")
    return joined.withColumn("_times", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
