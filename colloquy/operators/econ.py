"""Least squares from distributed sums: Gram matrices by task, a small solve on the driver.

What reaches the driver is k x k numbers per task (and, for cluster covariances,
per task again), whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, work_folder
from .quantiles import exact_quantiles

#: The control variables.
CONTROLS = ("eps_surprise", "revenue_surprise", "log_marketCap", "log_AvgVolume_m20_m1", "log_n_tokens_qa")


@dataclass
class Fit:
    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    n: int
    r2: float
    clusters: int | None = None
    rank: int = 0
    kind: str = "classical"

    @property
    def adjusted_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - self.rank) if self.n > self.rank else math.nan

    @property
    def errors(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def p_values(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.abs(self.params / self.errors)
        return np.array([math.erfc(x / math.sqrt(2)) if np.isfinite(x) else math.nan for x in t])

    def wald(self, a: str, b: str) -> dict:
        """Test of equal coefficients."""
        i, j = self.names.index(a), self.names.index(b)
        diff = self.params[i] - self.params[j]
        se = math.sqrt(max(0.0, self.cov[i, i] + self.cov[j, j] - 2 * self.cov[i, j]))
        t = diff / se if se else math.nan
        return {"diff": diff, "se": se, "t": t, "p": math.erfc(abs(t) / math.sqrt(2)) if se else math.nan}


def levels(df: DataFrame, column: str) -> list:
    """The sorted levels of a fixed effect that becomes columns (a bounded set: quarters)."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def ols(
    df: DataFrame, y: str, x: list[str], effects: tuple[str, ...] = (), cov: str = "classical", cluster: str | None = None, absorb: str | None = None,
) -> Fit:
    """cov: classical, hc1 or cluster. Rows with a missing value go first, and groups are taken from those that stay.

    ``effects`` become columns of the design (few levels: quarters). ``absorb`` is a fixed effect of any
    number of levels (firms): all columns are taken as differences from their means by level, which gives the same
    coefficients, errors and fit as a column for each level. The intercept is that of the least level; it is
    told unless its error would need a further pass (hc1, or clusters that are not the levels).
    """
    needed = [y, *x, *effects, *([cluster] if cluster else []), *([absorb] if absorb else [])]
    rows = df.dropna("any", subset=needed).select(*dict.fromkeys(needed))
    kinds = {e: levels(rows, e)[1:] for e in effects}
    names = [*([] if absorb else ["Intercept"]), *[f"{e}[{v}]" for e in effects for v in kinds[e]], *x]
    k = len(names)

    def plain(p: pd.DataFrame) -> np.ndarray:
        parts = ([] if absorb else [np.ones(len(p))]) + [(p[e] == v).to_numpy(float) for e in effects for v in kinds[e]] + [p[c].to_numpy(float) for c in x]
        return np.column_stack(parts) if len(p) else np.zeros((0, k))

    absorbed = 0
    if absorb:
        def by_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                own = pd.DataFrame(np.column_stack([np.ones(len(p)), p[y].to_numpy(float), plain(p)]))
                g = own.groupby(p[absorb].astype(str).to_numpy()).sum()
                yield pd.DataFrame({"_level": g.index, "s": list(g.to_numpy())})

        sums_ = rows.mapInPandas(by_level, "_level string, s array<double>").groupBy("_level").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k + 2)])
        means = sums_.select("_level", F.array(*[F.col(f"s{i}") / F.col("s0") for i in range(1, k + 2)]).alias("_means"))
        absorbed = means.count()
        rows = rows.withColumn("_level", F.col(absorb).cast("string")).join(means, "_level").drop("_level")

    def middle(p: pd.DataFrame) -> np.ndarray:
        return np.stack(p["_means"].to_numpy()) if absorb and len(p) else np.zeros((len(p), k + 1))

    def design(p: pd.DataFrame) -> np.ndarray:
        return plain(p) - middle(p)[:, 1:]

    def outcome(p: pd.DataFrame) -> np.ndarray:
        return p[y].to_numpy(float) - middle(p)[:, 0]

    def sums(width: int, one) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for p in batches:
                total += one(p)
            yield pd.DataFrame({"v": [total.tolist()]})

        return sum((np.array(r["v"]) for r in rows.mapInPandas(run, "v array<double>").collect()), np.zeros(width))

    def gram(p: pd.DataFrame) -> np.ndarray:
        d, t, raw = design(p), outcome(p), p[y].to_numpy(float)
        return np.concatenate([(d.T @ d).ravel(), d.T @ t, [t @ t, raw @ raw, raw.sum(), len(t)]])

    s = sums(k * k + k + 4, gram)
    xtx, xty, (yy, squares, total, n) = s[: k * k].reshape(k, k), s[k * k : -4], s[-4:]
    inv = np.linalg.pinv(xtx)
    b = inv @ xty
    rank = int(np.linalg.matrix_rank(xtx)) + absorbed if n else 0
    rss, tss = float(yy - b @ xty), float(squares - total**2 / n) if n else math.nan
    clusters = None
    if cov == "classical":
        v = inv * rss / max(1, n - rank)
    elif cov == "hc1":
        def meat(p: pd.DataFrame) -> np.ndarray:
            d = design(p)
            e = outcome(p) - d @ b
            return ((d * (e * e)[:, None]).T @ d).ravel()

        v = inv @ sums(k * k, meat).reshape(k, k) @ inv * n / max(1, n - rank)
    else:
        # Scores are summed by cluster within each task, then over tasks by a grouped sum, then their outer products.
        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                d = design(p)
                u = pd.DataFrame(d * (outcome(p) - d @ b)[:, None])
                g = u.groupby(p[cluster].astype(str).to_numpy()).sum()
                yield pd.DataFrame({"g": g.index, "s": list(g.to_numpy())})

        each = rows.mapInPandas(scores, "g string, s array<double>")
        total = each.groupBy("g").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)]).select(F.array(*[f"s{i}" for i in range(k)]).alias("s"))

        def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, count = np.zeros((k, k)), 0
            for p in batches:
                if len(p):
                    a = np.stack(p["s"].to_numpy())
                    m += a.T @ a
                    count += len(a)
            yield pd.DataFrame({"v": [[*m.ravel().tolist(), float(count)]]})

        s = sum((np.array(r["v"]) for r in total.mapInPandas(outer, "v array<double>").collect()), np.zeros(k * k + 1))
        clusters = int(s[-1])
        small = clusters / max(1, clusters - 1) * (n - 1) / max(1, n - rank)
        v = inv @ s[:-1].reshape(k, k) @ inv * small
    if absorb and n and (cov == "classical" or cluster == absorb):
        first = rows.groupBy(absorb).agg(F.count("*").alias("n"), F.first("_means").alias("m")).orderBy(absorb).first()
        least, size = first["m"], first["n"]
        at = np.array(least[1:])
        # Within a level the errors add up to 0, so a sum over clusters that are levels sees only the coefficients' part.
        own = float(at @ v @ at) + (rss / max(1, n - rank) / size if cov == "classical" else 0.0)
        v = np.block([[np.array([[own]]), -(at @ v)[None, :]], [-(v @ at)[:, None], v]])
        names, b = ["Intercept", *names], np.concatenate([[least[0] - at @ b], b])
    return Fit(names, b, v, int(n), 1 - rss / tss if tss else math.nan, clusters, rank, cov)


@dataclass(frozen=True)
class Model:
    """What to fit. ``columns`` names a column that stands for a variable in this model, ``keep`` a boolean column of the rows that belong to it."""

    name: str
    y: str
    x: tuple[str, ...]
    effects: tuple[str, ...] = ()
    cov: str = "classical"
    cluster: str | None = None
    absorb: str | None = None
    keep: str | None = None
    columns: tuple[tuple[str, str], ...] = ()

    def column(self, variable: str) -> str:
        return dict(self.columns).get(variable, variable)

    @property
    def sample(self) -> tuple:
        """What a row must have: models of one sample share their sums."""
        groups = {*self.effects, *([self.cluster] if self.cluster else []), *([self.absorb] if self.absorb else [])}
        return tuple(sorted(map(self.column, (self.y, *self.x)))), tuple(sorted(groups)), self.keep


ROW = "kind string, key string, v array<double>"


def fit_all(df: DataFrame, models: list[Model]) -> list[Fit]:
    """All models from two passes over ``df`` (and one over the effects' columns for their levels).

    The first pass adds up, per sample, one Gram matrix over a constant, all levels and all variables, and per absorbed level the sums of its rows.
    Coefficients come from sub-matrices; an absorbed effect takes away what lies between its levels. The second pass adds up the scores of all
    models by cluster at once. Sums are added by exchange, so the driver gets rows of matrices alone, whatever the number of tasks,
    rows and clusters. Rows that lack a value a model needs are left out of that model.
    """
    bad = [m.name for m in models if m.absorb and not (m.cov == "classical" or m.cov == "cluster" and m.cluster == m.absorb)]
    if bad:
        raise ValueError(f"{bad}: with an absorbed effect, errors are classical or clustered by it (see ols)")
    spark = df.sparkSession
    variables = list(dict.fromkeys(m.column(v) for m in models for v in (m.y, *m.x)))
    effects = list(dict.fromkeys(e for m in models for e in m.effects))
    groups = list(dict.fromkeys(g for m in models for g in (*m.effects, m.cluster, m.absorb) if g))
    keeps = list(dict.fromkeys(m.keep for m in models if m.keep))
    rows = df.select(*[F.col(v).cast("double").alias(v) for v in variables], *[F.col(g).cast("string").alias(g) for g in groups if g not in variables], *keeps)
    levels_of = {e: levels(rows, e) for e in effects}
    names = ["Intercept", *[f"{e}[{v}]" for e in effects for v in levels_of[e]], *variables]
    place, width = {n: i for i, n in enumerate(names)}, len(names)
    samples = list(dict.fromkeys(m.sample for m in models))
    absorbed = list(dict.fromkeys((samples.index(m.sample), m.absorb) for m in models if m.absorb))

    def matrix_of(p: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """(one row per row over all columns, mask of each sample); what is missing is 0 where no sample that needs it has the row."""
        values = p[variables].to_numpy(float) if variables else np.zeros((len(p), 0))
        there = {v: ~np.isnan(values[:, i]) for i, v in enumerate(variables)} | {g: p[g].notna().to_numpy() for g in groups}
        dummies = [(p[e] == v).to_numpy(float) for e in effects for v in levels_of[e]]
        whole = np.column_stack([np.ones(len(p)), *dummies, np.nan_to_num(values)])
        masks = []
        for needed, by, keep in samples:
            mask = np.ones(len(p), bool)
            for c in (*needed, *by):
                mask &= there[c]
            masks.append(mask & p[keep].fillna(False).to_numpy(bool) if keep else mask)
        return whole, masks

    def by_key(kind: str, keys: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        codes, found = pd.factorize(keys)
        total = np.zeros((len(found), width))
        np.add.at(total[:, : m.shape[1]], codes, m)
        return pd.DataFrame({"kind": kind, "key": found, "v": list(total)})

    def matrix_rows(kind: str, m: np.ndarray) -> pd.DataFrame:
        wide = np.zeros((len(m), width))
        wide[:, : m.shape[1]] = m
        return pd.DataFrame({"kind": kind, "key": [str(i) for i in range(len(m))], "v": list(wide)})

    def added(parts: DataFrame) -> DataFrame:
        sums = parts.groupBy("kind", "key").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
        return sums.select("kind", "key", F.array(*[f"s{i}" for i in range(width)]).alias("v"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = [np.zeros((width, width)) for _ in samples]
        for p in batches:
            if len(p):
                whole, masks = matrix_of(p)
                for g, mask in zip(grams, masks):
                    g += whole[mask].T @ whole[mask]
                for s, column in absorbed:
                    if masks[s].any():  # of no rows, pandas makes no column of arrays
                        yield by_key(f"level {s} {column}", p[column].to_numpy()[masks[s]], whole[masks[s]])
        for s, g in enumerate(grams):
            yield matrix_rows(f"gram {s}", g)

    path = work_folder(spark, "sums")
    added(rows.mapInPandas(first, ROW)).write.parquet(path)
    sums = spark.read.schema(ROW).parquet(path)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over levels of the products of their sums, by their rows; a further row has the number of levels."""
        total: dict[str, np.ndarray] = {}
        for p in batches:
            for kind, part in p.groupby("kind"):
                v = np.stack(part["v"].to_numpy())
                m = np.vstack([v.T @ (v / v[:, :1]), np.eye(1, width) * len(v)])
                total[kind] = total.get(kind, 0) + m
        for kind, m in total.items():
            yield matrix_rows(kind, m)

    def gathered(parts: DataFrame) -> dict[str, np.ndarray]:
        out: dict[str, dict[int, np.ndarray]] = {}
        for r in parts.collect():  # rows of matrices
            out.setdefault(r["kind"], {})[int(r["key"])] = np.array(r["v"])
        return {kind: np.stack([m[i] for i in sorted(m)]) for kind, m in out.items()}

    grams = gathered(sums.filter(F.col("kind").startswith("gram")))
    middle = gathered(added(sums.filter(F.col("kind").startswith("level")).mapInPandas(between, ROW))) if absorbed else {}
    lowest = {}
    if absorbed:
        low = sums.filter(F.col("kind").startswith("level")).groupBy("kind").agg(F.min(F.struct("key", "v")).alias("r"))
        lowest = {r["kind"]: np.array(r["r"]["v"]) for r in low.collect()}

    solved = []
    for m in models:
        s = samples.index(m.sample)
        gram = grams.get(f"gram {s}", np.zeros((width, width)))
        n, yi = gram[0, 0], place[m.column(m.y)]
        dummies = []
        for e in m.effects:
            seen = [place[f"{e}[{v}]"] for v in levels_of[e] if gram[place[f"{e}[{v}]"], place[f"{e}[{v}]"]] > 0]
            dummies += seen[1:]
        cols = [*([] if m.absorb else [0]), *dummies, *[place[m.column(v)] for v in m.x]]
        shown = [*([] if m.absorb else ["Intercept"]), *[names[i] for i in dummies], *m.x]
        within, count = gram, 0
        if m.absorb and n:
            among = middle[f"level {s} {m.absorb}"]
            within, count = gram - among[:width], int(round(among[width, 0]))
        xtx, xty, yy = within[np.ix_(cols, cols)], within[cols, yi], within[yi, yi]
        inv = np.linalg.pinv(xtx)
        b = inv @ xty
        rank = int(np.linalg.matrix_rank(xtx)) + count if n else 0
        rss, tss = float(yy - b @ xty), float(gram[yi, yi] - gram[0, yi] ** 2 / n) if n else math.nan
        solved.append((s, cols, yi, shown, inv, b, rank, rss, tss, int(n)))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meat: dict[int, np.ndarray] = {}
        for p in batches:
            if len(p):
                whole, masks = matrix_of(p)
                for j, m in enumerate(models):
                    s, cols, yi, _, _, b, *_ = solved[j]
                    if m.cov == "classical" or not masks[s].any():
                        continue
                    d = whole[np.ix_(masks[s], cols)]
                    e = whole[masks[s], yi] - d @ b
                    if m.cov == "hc1":
                        meat[j] = meat.get(j, 0) + (d * (e * e)[:, None]).T @ d
                    else:
                        yield by_key(f"score {j}", p[m.cluster].to_numpy()[masks[s]], d * e[:, None])
        for j, total in meat.items():
            yield matrix_rows(f"meat {j}", total)

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for p in batches:
            done = p[p["kind"].str.startswith("meat")]
            if len(done):
                yield done[["kind", "key", "v"]]
            for kind, part in p[p["kind"].str.startswith("score")].groupby("kind"):
                s, cols, yi, _, _, b, *_ = solved[int(kind.split()[1])]
                u = np.stack(part["v"].to_numpy())[:, : len(cols)]
                has = part["level"].notna().to_numpy()
                if has.any():  # an absorbed effect: what its level's mean takes from the scores
                    lv = np.stack(part["level"][has].to_numpy())
                    mean = lv / lv[:, :1]
                    u[has] -= lv[:, cols] * (mean[:, yi] - mean[:, cols] @ b)[:, None]
                m = np.zeros((width + 1, width))
                m[: len(cols), : len(cols)] = u.T @ u
                m[width, 0] = len(u)
                total[kind] = total.get(kind, 0) + m
        for kind, m in total.items():
            yield matrix_rows(kind, m)

    middles = {}
    if any(m.cov != "classical" for m in models):
        scores = added(rows.mapInPandas(second, ROW))
        like = [(f"score {j}", f"level {solved[j][0]} {m.absorb}") for j, m in enumerate(models) if m.absorb and m.cov == "cluster"]
        if like:
            pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("of")) for a, b in like]))
            lv = sums.select(F.col("kind").alias("have"), "key", F.col("v").alias("level"), pairs.alias("p")).filter("have = p.of").select("p.kind", "key", "level")
            scores = scores.join(lv, ["kind", "key"], "left")
        else:
            scores = scores.withColumn("level", F.lit(None).cast("array<double>"))
        middles = gathered(added(scores.mapInPandas(outer, ROW)))

    out = []
    for j, m in enumerate(models):
        s, cols, _, shown, inv, b, rank, rss, tss, n = solved[j]
        k, clusters = len(cols), None
        if m.cov == "classical":
            v = inv * rss / max(1, n - rank)
        elif m.cov == "hc1":
            meat = middles.get(f"meat {j}", np.zeros((k, width)))
            v = inv @ meat[:k, :k] @ inv * n / max(1, n - rank)
        else:
            meat = middles.get(f"score {j}", np.zeros((width + 1, width)))
            clusters = int(round(meat[width, 0]))
            v = inv @ meat[:k, :k] @ inv * (clusters / max(1, clusters - 1) * (n - 1) / max(1, n - rank))
        if m.absorb and n:
            low = lowest[f"level {s} {m.absorb}"]
            at = low[cols] / low[0]
            own = float(at @ v @ at) + (rss / max(1, n - rank) / low[0] if m.cov == "classical" else 0.0)
            v = np.block([[np.array([[own]]), -(at @ v)[None, :]], [-(v @ at)[:, None], v]])
            shown, b = ["Intercept", *shown], np.concatenate([[low[solved[j][2]] / low[0] - at @ b], b])
        out.append(Fit(shown, b, v, n, 1 - rss / tss if tss else math.nan, clusters, rank, m.cov))
    return out


#: Name, regressors beside the controls, firm effects, covariance, sample.
SPECS = (
    ("main", ("NegPrepared", "NegGap"), False, "cluster", "all"),
    ("prepared_and_qa", ("NegPrepared", "NegQA"), False, "cluster", "all"),
    ("firm_effects", ("NegPrepared", "NegGap"), True, "cluster", "all"),
    ("hc1", ("NegPrepared", "NegGap"), False, "hc1", "all"),
    ("trimmed", ("NegPrepared", "NegGap"), False, "cluster", "trimmed"),
    ("long_qa", ("NegPrepared", "NegGap"), False, "cluster", "long"),
    ("seglenw", ("NegPrepared_seglenw", "NegGap_seglenw"), False, "cluster", "all"),
    ("segmax", ("NegPrepared_segmax", "NegGap_segmax"), False, "cluster", "all"),
    ("joint_seglenw", ("NegPrepared_seglenw", "NegQA_seglenw"), False, "cluster", "all"),
    ("joint_segmax", ("NegPrepared_segmax", "NegQA_segmax"), False, "cluster", "all"),
)
#: Regressors, with controls, with quarter effects.
PROGRESSIVE = ((("NegPrepared",), False, False), (("NegGap",), False, False), (("NegPrepared", "NegGap"), False, False), (("NegPrepared", "NegGap"), True, False), (("NegPrepared", "NegGap"), True, True))


def measures() -> list[str]:
    """The tone measures of the specifications."""
    return list(dict.fromkeys(v for _, x, *_ in SPECS for v in x))


def models(y: str = "CAR_m1_p1", firm: str = "ticker_norm", quarter: str = "year_quarter") -> list[Model]:
    """The table of specifications and the progressive ones. Trimmed columns are named ``<column>_cut``, long calls are marked by ``is_long``."""
    out = []
    for name, x, firms, cov, sample in SPECS:
        x = (*x, *CONTROLS)
        cut = tuple((c, f"{c}_cut") for c in (y, *x)) if sample == "trimmed" else ()
        out.append(Model(name, y, x, (quarter,), cov, firm if cov == "cluster" else None, firm if firms else None, "is_long" if sample == "long" else None, cut))
    for i, (x, controls, quarters) in enumerate(PROGRESSIVE, 1):
        out.append(Model(f"progressive_{i}", y, (*x, *(CONTROLS if controls else ())), (quarter,) if quarters else (), "cluster", firm))
    return out


def fits(df: DataFrame, y: str = "CAR_m1_p1", firm: str = "ticker_norm", quarter: str = "year_quarter"):
    """(name, regressors, fit) of the table of specifications and of the progressive ones.

    The columns that they need are written once to the shared folder, in order of the firms: so a firm's rows stand in one file or two, and its
    sums don't come from every task. A firm of many rows is cut by quarter and outcome. Then come two passes for the cuts and the median, one for the quarters
    and two for all fits.
    """
    from ..functions import numeric as N

    needed = dict.fromkeys([y, *CONTROLS, *measures()])
    path = work_folder(df.sparkSession, "regression")
    chosen = df.select(*[F.col(c).cast("double").alias(c) for c in needed], firm, quarter)
    chosen.repartitionByRange(firm, quarter, y).sortWithinPartitions(firm).write.parquet(path)
    released(df.sparkSession)
    data = df.sparkSession.read.parquet(path)
    trimmed = [y, "NegPrepared", "NegGap", *CONTROLS]
    cuts = dict(zip(trimmed, exact_quantiles(data, trimmed, [0.01, 0.5, 0.99])))
    data = data.withColumns({f"{c}_cut": N.clip(F.col(c), q[0], q[2]) if q else F.col(c) for c, q in cuts.items()})
    middle = cuts["log_n_tokens_qa"]
    data = data.withColumn("is_long", F.coalesce(F.col("log_n_tokens_qa") >= middle[1], F.lit(False)) if middle else F.lit(False))
    all_ = models(y, firm, quarter)
    regressors = [x for _, x, *_ in SPECS] + [x for x, *_ in PROGRESSIVE]
    for m, x, fit in zip(all_, regressors, fit_all(data, all_)):
        yield m.name, list(x), fit


def rows_of(name: str, fit: Fit) -> list[tuple]:
    p = fit.p_values()
    return [(name, n, float(b), float(e), float(q), fit.n, float(fit.r2)) for n, b, e, q in zip(fit.names, fit.params, fit.errors, p) if "[" not in n]


def all_specs(df: DataFrame, y: str = "CAR_m1_p1", firm: str = "ticker_norm", quarter: str = "year_quarter") -> list[tuple]:
    """(spec, variable, coef, se, p, n, r2) of all fits and the Wald test."""
    out = []
    for name, _, fit in fits(df, y, firm, quarter):
        out += rows_of(name, fit)
        if name == "prepared_and_qa":
            w = fit.wald("NegQA", "NegPrepared")
            out.append(("wald_qa_prepared", "NegQA - NegPrepared", float(w["diff"]), float(w["se"]), float(w["p"]), fit.n, float(fit.r2)))
    return out
