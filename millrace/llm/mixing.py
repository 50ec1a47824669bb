"""Mixing documents to target weights by soft domain membership.

A classifier over hashed words learns the domains from labelled documents: each
word has a posterior over domains, weighted by how telling it is. Their sum over
a document is unmixed by what each domain's words sum to on average, and a power
calibrated on labelled documents makes it a posterior. Document rates are then fitted by
least squares under the targets, as the expected tokens of each domain, summed
over documents as rate x tokens x posterior. Rates are projected to their bounds
in every step.

Column expressions and aggregates only. Rates are fitted over cells of like
posteriors, a bounded table, and finished over the rows in a few passes that
return D + D^2 sums each; a document's rate is a function of its posterior and
of D coefficients, so no rates are stored between steps. The model has one row
per bucket and is broadcast within that bound.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, named, renamed, row_key

SPACE = r"[\x20\x09-\x0D]+"
APART = r"[\x20\x09-\x0D.,;:!?\"'`#*$%&|<>()\[\]{}=_+/\\~^@-]+"

FLOOR = 1e-3  #: least share of a domain in a document, before the power


def _bucket(word: Column, buckets: int) -> Column:
    return F.when(word.isNotNull(), F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _evidence(text: Column, buckets: int) -> Column:
    """Distinct buckets of a text's words without marks: a repeated word or sign
    says no more about the domain than one."""
    words = F.filter(F.split(F.lower(text), APART), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: _bucket(w, buckets)))


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit("mix"), "doc_id"), "doc_id")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang", buckets: int = 4096, train_docs: int = 2000, text: str = "text", smoothing: float = 0.5) -> DataFrame:
    """(bucket, g0, g1, ..., f0, f1, ...): posterior of each domain for a word of the
    bucket, times how far the best is above chance, and the bucket's share of each
    domain's words. From at most ``train_docs`` documents
    of the labelled table, lowest by id hash."""
    pick = _labelled(labels).limit(train_docs)
    own = docs.join(F.broadcast(pick), "doc_id", "left_semi").where(F.col(domain).isin(domains))
    seen = own.select(F.col(domain).alias("d"), F.explode(_evidence(F.col(text).cast("string"), buckets)).alias("bucket"))
    counts = seen.groupBy("d", "bucket").agg(F.count("*").alias("n"))
    k = range(len(domains))
    wide = counts.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("d") == name, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, name in enumerate(domains)))
    totals = wide.agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in k))
    both = wide.crossJoin(F.broadcast(totals))  # one row of totals
    both = both.select("bucket", *(((F.col(f"n{i}") + smoothing) / (F.col(f"t{i}") + smoothing * buckets)).alias(f"f{i}") for i in k))
    total = sum((F.col(f"f{i}") for i in k), F.lit(0.0))
    both = both.select("bucket", *((F.col(f"f{i}") / total).alias(f"p{i}") for i in k), *(f"f{i}" for i in k))
    sure = F.array_max(F.array(*(F.col(f"p{i}") for i in k))) - 1 / len(domains)
    return both.select("bucket", *((F.col(f"p{i}") * sure).alias(f"g{i}") for i in k), *(f"f{i}" for i in k))


def unmixing(model: DataFrame, n: int) -> np.ndarray:
    """Matrix from a document's summed word weights to its tokens by domain. A
    domain's own words give it on average a row of weights that leaks to the
    others; the inverse of these rows takes the leak back."""
    got = model.agg(*(F.sum(F.col(f"f{d}") * F.col(f"g{j}")).alias(f"m{d}_{j}") for d in range(n) for j in range(n))).first()
    return np.linalg.pinv(np.array([x or 0.0 for x in got]).reshape(n, n).T, rcond=1e-6)


def posteriors(docs: DataFrame, model: DataFrame, n: int, buckets: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",), power: float = 1.0) -> DataFrame:
    """``keep``, n_tokens and p (array of ``n``) for each row: the words' weights
    summed, unmixed and raised to ``power``, so that one domain's documents are
    sharp and evenly mixed ones stay mixed. A document without a telling word has an even posterior."""
    own = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")).withColumn("__row", F.monotonically_increasing_id())
    # counted before the explode, which would count again for each word
    own = own.withColumn("n_tokens", F.size(_words(F.col("__t"))).cast("long"))
    words = own.select(*keep, "__row", "n_tokens", F.explode_outer(_evidence(F.col("__t"), buckets)).alias("bucket"))
    hit = words.join(F.broadcast(model.select("bucket", *(f"g{i}" for i in range(n)))), "bucket", "left")
    sums = hit.groupBy("__row", *keep).agg(F.max("n_tokens").alias("n_tokens"), *(F.coalesce(F.sum(f"g{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(n)))
    back = unmixing(model, n)
    sums = sums.select(*keep, "n_tokens", *(F.greatest(F.lit(0.0), sum((F.col(f"g{j}") * float(back[i, j]) for j in range(n)), F.lit(0.0))).alias(f"g{i}") for i in range(n)))
    total = sum((F.col(f"g{i}") for i in range(n)), F.lit(0.0))
    sums = sums.select(*keep, "n_tokens", *(F.when(total > 0, F.pow(F.col(f"g{i}") / F.when(total > 0, total) + FLOOR, F.lit(float(power)))).otherwise(1.0).alias(f"g{i}") for i in range(n)))
    total = sum((F.col(f"g{i}") for i in range(n)), F.lit(0.0))
    return sums.select(*keep, "n_tokens", F.array(*(F.col(f"g{i}") / total for i in range(n))).alias("p"))


def calibrated(docs: DataFrame, labels: DataFrame, model: DataFrame, domains: list[str], domain: str, buckets: int, train_docs: int) -> float:
    """The power that predicts the domain of labelled documents best, by log loss
    per token; of about equal ones the smallest. On labelled documents that the
    model has not seen, if there are any, at most ``train_docs``."""
    n, powers = len(domains), (1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
    order = _labelled(labels)
    for pick in (order.offset(train_docs).limit(train_docs), order.limit(train_docs)):
        own = docs.select("doc_id", "text", F.col(domain).alias("__d")).join(F.broadcast(pick), "doc_id", "left_semi").where(F.col("__d").isin(domains))
        p = posteriors(own, model, n, buckets=buckets, keep=("__d",))
        power_sum = lambda c: sum((F.pow(F.col("p")[i], F.lit(c)) for i in range(n)), F.lit(0.0))
        true = F.coalesce(*(F.when(F.col("__d") == x, F.col("p")[i]) for i, x in enumerate(domains)))
        loss = p.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * (F.log(power_sum(c)) - c * F.log(true))) for c in powers)).first()
        if loss[0]:
            each = [x / loss[0] for x in loss[1:]]
            return next(c for c, x in zip(powers, each) if x <= min(each) + 2e-3)
    return 1.0


def _rate(dual: list[float], cap: float | None = None) -> Column:
    r = F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("p")[i] * float(x) for i, x in enumerate(dual)), F.lit(0.0)))
    return r if cap is None else F.least(F.lit(float(cap)), r)


def _grid(n: int, most: int = 50_000) -> int:
    """The finest grid, up to 64 steps, whose cells over ``n`` shares number at most ``most``."""
    return max(g for g in range(1, 65) if g == 1 or math.comb(g + n - 1, n - 1) <= most)


def _sums(n: int, tokens: np.ndarray, p: np.ndarray, dual: np.ndarray, cap: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens by domain, Gram matrix of the free rows, and the dual's row part."""
    slack = p @ dual
    r = np.clip(1 - slack, 0, cap)
    free = (r > 0) & (True if cap is None else 1 - slack <= cap)
    return (tokens * r) @ p, (p[free] * tokens[free, None]).T @ p[free], float((tokens * ((r - 1) ** 2 / 2 + r * slack)).sum())


def fit_rates(table: DataFrame, weights: list[float], total: float | None = None, cap: float | None = None, rounds: int = 60, tolerance: float = 1e-6, passes: int = 8) -> tuple[list[float], float]:
    """(one coefficient per domain, residual as a share of the total). Rates are
    the nearest to one, token-weighted, that lie in [0, ``cap``] and give each
    domain its tokens. Their dual has one number per domain and is concave; it is
    climbed by Newton steps on the D x D Gram matrix of the rows whose rate is
    not at a bound, halved until the dual gains.

    The climb runs on the driver over cells of like posteriors (a grid of at most
    some 50 000, each with its tokens and its mean posterior); steps over the
    rows themselves, at most ``passes``, then take the error of that away.

    ``total`` tokens are asked for; by default as many as the scarcest domain
    allows without repeating documents, and with a ``cap`` the most, in steps of
    3 %, that rates within it can meet. Domains without any tokens can't be met;
    the others are fitted to their own weights. A residual above ``tolerance``
    is warned of.
    """
    n = len(weights)
    pair = [(i, j) for i in range(n) for j in range(i, n)]
    grid = _grid(n)
    cell = F.transform("p", lambda x: F.round(x * grid).cast("int"))
    sums = [F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    got = table.where("n_tokens > 0").groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("n"), *sums).collect()
    if not got:
        return [0.0] * n, 0.0
    tokens = np.array([float(r["n"]) for r in got])
    p = np.array([[r[f"s{i}"] for i in range(n)] for r in got]) / tokens[:, None]

    def over_cells(dual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return _sums(n, tokens, p, dual, cap)

    def over_rows(dual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        rows = table.select("n_tokens", "p", _rate(list(dual), cap).alias("r"))
        slack = sum((F.col("p")[i] * float(x) for i, x in enumerate(dual)), F.lit(0.0))
        free = (F.col("r") > 0) & (F.lit(True) if cap is None else (F.lit(1.0) - slack <= cap))
        each = [F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[i]) for i in range(n)]
        each += [F.sum(F.when(free, F.col("n_tokens") * F.col("p")[i] * F.col("p")[j])) for i, j in pair]
        each += [F.sum(F.col("n_tokens") * ((F.col("r") - 1) * (F.col("r") - 1) / 2 + F.col("r") * slack))]
        out = np.array([x or 0.0 for x in rows.agg(*(x.alias(f"s{k}") for k, x in enumerate(each))).first()])
        gram = np.zeros((n, n))
        for (i, j), x in zip(pair, out[n:-1]):
            gram[i, j] = gram[j, i] = x
        return out[:n], gram, float(out[-1])

    have = over_cells(np.zeros(n))[0]
    w = np.where(have > 0, weights, 0.0)
    if not w.sum():
        return [0.0] * n, 0.0
    w = w / w.sum()
    most = min(h / x for h, x in zip(have, w) if x > 0)

    def climb(goal: np.ndarray, dual: np.ndarray, look, looks: int) -> tuple[np.ndarray, float]:
        now, gram, part = look(dual)
        looks -= 1
        while looks > 0:
            rest = np.where(have > 0, now - goal, 0.0)
            if np.abs(rest).max() <= tolerance * goal.sum():
                break
            ridge = 1e-9 * max(np.trace(gram), 1e-6 * have.sum()) * np.eye(n)
            step, size, value = np.linalg.solve(gram + ridge, rest), 1.0, part - dual @ goal
            while size > 1e-4 and looks > 0:
                trial = dual + size * step
                found = look(trial)
                looks -= 1
                if found[2] - trial @ goal >= value + 1e-4 * size * (step @ rest) - 1e-12 * abs(value):
                    dual, (now, gram, part) = trial, found
                    break
                size /= 2
            else:
                break
        return dual, float(np.abs(np.where(have > 0, now - goal, 0.0)).max() / goal.sum())

    ask, dual, residual = total or most, np.zeros(n), math.inf
    for _ in range(1 if total or cap is None else 60):
        dual, residual = climb(ask * w, np.zeros(n), over_cells, 20 * rounds)
        if residual <= tolerance:
            break
        ask *= 0.97
    if residual <= 1e-3:  # else the targets are out of reach, and rows would show the same
        dual, residual = climb(ask * w, dual, over_rows, passes)
    if residual > tolerance or (np.array(weights)[have <= 0] > 0).any():
        lost = [i for i in range(n) if weights[i] > 0 and have[i] <= 0]
        warnings.warn(f"mixing targets not met: residual {residual:.2e} of {ask:.0f} tokens, domains without tokens: {lost}", stacklevel=2)
    return [float(x) for x in dual], residual


def mix(docs: DataFrame, labels: DataFrame, scratch: Scratch, targets: dict[str, float], domain: str = "lang", total: float | None = None, buckets: int = 4096, train_docs: int = 2000, keep: tuple[str, ...] = ("doc_id",), cap: float | None = None) -> DataFrame:
    """One row per input row: ``keep``, n_tokens, p_<domain> for each target, rate
    (nonnegative, expected copies) and copies (rate rounded up or down by a hash
    of the id, so that totals are kept on average).

    Null and wordless texts have no tokens and an even posterior; repeated rows
    each get a row; a null doc_id is kept; without labelled rows all posteriors
    are even; an empty table gives no rows. Target weights need not sum to 1.
    """
    names = list(targets)
    if not names or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative and not all zero")
    model = scratch.keep(fit_domains(docs, labels, names, domain, buckets, train_docs), "model")
    power = calibrated(docs, labels, model, names, domain, buckets, train_docs)
    table = scratch.keep(posteriors(docs, model, len(names), buckets=buckets, keep=keep, power=power), "posteriors")
    dual, _ = fit_rates(table, [targets[x] for x in names], total, cap)
    out = table.withColumn("rate", _rate(dual, cap))
    u = F.pmod(F.xxhash64(F.lit("copies"), keep[0]), F.lit(1 << 20)) / (1 << 20)
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return out.select(*keep, "n_tokens", *(F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(names)), "rate", copies.alias("copies"))


def thin(docs: DataFrame, labels: DataFrame, scratch: Scratch, targets: dict[str, float], domain: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the mix keeps, each at most once: rates are fitted
    within [0, 1] and are chances to stay. All columns are kept, whatever their
    names. Rows equal in id and text stay or go together; null and wordless texts
    have an even posterior; an empty table gives no rows."""
    plain, back = renamed(docs)
    own = plain.select(F.col(back["doc_id"]).alias("doc_id"), F.col(back["text"]).alias("text"), F.col(back[domain]).alias(domain)).withColumn("row", row_key())
    found = mix(own, labels, scratch, targets, domain, keep=("doc_id", "row"), cap=1.0)
    kept = scratch.keep(found.where("copies > 0").select("row").distinct(), "kept")
    return plain.withColumn("row", row_key(back["doc_id"], back["text"])).join(kept, "row", "left_semi").select(*named(back))
