"""All specifications at once against dense least squares in numpy, and against one fit at a time."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import econ

NAMES = ["CAR_m1_p1", *econ.CONTROLS, *[f"Neg{s}{t}" for s in ("Prepared", "QA", "Gap") for t in ("", "_seglenw", "_segmax")]]


@pytest.fixture(scope="module")
def data():
    """Missing values by column, a hot firm, firms and quarters that some samples lack."""
    rng = np.random.default_rng(11)
    n = 900
    x = pd.DataFrame(rng.normal(size=(n, len(NAMES))), columns=NAMES)
    x["CAR_m1_p1"] += 0.4 * x["NegPrepared"] - 0.2 * x["NegGap"] + 0.1 * np.arange(n) % 3
    for c in NAMES:
        x.loc[rng.random(n) < 0.04, c] = np.nan
    x["ticker_norm"] = np.where(np.arange(n) % 3 == 0, "hot", [f"t{k}" for k in rng.integers(0, 40, n)])
    x["year_quarter"] = [f"202{k // 4}Q{k % 4 + 1}" for k in rng.integers(0, 9, n)]
    x.loc[x["year_quarter"] == "2020Q1", "NegQA"] = np.nan
    x.loc[:9, "year_quarter"], x.loc[10:14, "ticker_norm"] = None, None
    return x


def dense(d, y, x, quarter, cov, firms):
    """(names, coefficients, covariance, n, r2, clusters) with a column for each level."""
    d = d.dropna(subset=[y, *x, *(["year_quarter"] if quarter else []), *(["ticker_norm"] if cov == "cluster" or firms else [])])
    parts, names = [np.ones(len(d))], ["Intercept"]
    for e in [*(["year_quarter"] if quarter else []), *(["ticker_norm"] if firms else [])]:
        for v in sorted(d[e].unique())[1:]:
            parts.append((d[e] == v).to_numpy(float))
            names.append(f"{e}[{v}]")
    m, t = np.column_stack([*parts, d[list(x)].to_numpy()]), d[y].to_numpy()
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ t
    e, n, k = t - m @ b, *m.shape
    clusters = None
    if cov == "hc1":
        v = inv @ ((m * (e * e)[:, None]).T @ m) @ inv * n / (n - k)
    else:
        s = pd.DataFrame(m * e[:, None]).groupby(d["ticker_norm"].to_numpy()).sum().to_numpy()
        clusters = len(s)
        v = inv @ (s.T @ s) @ inv * clusters / (clusters - 1) * (n - 1) / (n - k)
    return [*names, *x], b, v, n, 1 - e @ e / ((t - t.mean()) ** 2).sum(), clusters


def expected(data):
    y, out = "CAR_m1_p1", {}
    for name, x, firms, cov, sample in econ.SPECS:
        d = data.copy()
        if sample == "trimmed":
            for c in [y, "NegPrepared", "NegGap", *econ.CONTROLS]:
                d[c] = d[c].clip(d[c].quantile(0.01), d[c].quantile(0.99))
        if sample == "long":
            d = d[d["log_n_tokens_qa"] >= d["log_n_tokens_qa"].median()]
        out[name] = dense(d, y, (*x, *econ.CONTROLS), True, cov, firms)
    for i, (x, controls, quarters) in enumerate(econ.PROGRESSIVE, 1):
        out[f"progressive_{i}"] = dense(data, y, (*x, *(econ.CONTROLS if controls else ())), quarters, "cluster", False)
    return out


def test_all_fits_and_the_wald_test_against_numpy(spark, data):
    df = spark.createDataFrame(data).repartition(5)
    want, got = expected(data), {name: fit for name, _, fit in econ.fits(df)}
    assert list(got) == list(want) and len(got) == 15
    for name, (names, b, v, n, r2, clusters) in want.items():
        fit = got[name]
        at = [names.index(c) for c in fit.names]
        assert (fit.n, fit.clusters) == (n, clusters) and fit.r2 == pytest.approx(r2), name
        assert np.allclose(fit.params, b[at], rtol=1e-7, atol=1e-9) and np.allclose(fit.cov, v[np.ix_(at, at)], rtol=1e-6, atol=1e-10), name
    names, b, v, *_ = want["prepared_and_qa"]
    i, j = names.index("NegQA"), names.index("NegPrepared")
    w = got["prepared_and_qa"].wald("NegQA", "NegPrepared")
    se = math.sqrt(v[i, i] + v[j, j] - 2 * v[i, j])
    assert w["diff"] == pytest.approx(b[i] - b[j]) and w["se"] == pytest.approx(se) and w["p"] == pytest.approx(math.erfc(abs(b[i] - b[j]) / se / math.sqrt(2)))
    rows = econ.all_specs(df)
    assert [r[0] for r in rows if r[1] == "NegQA - NegPrepared"] == ["wald_qa_prepared"] and len({r[0] for r in rows}) == 16


def test_passes_over_the_data(spark, data, monkeypatch):
    """Two passes for the fits, however many there are, and one for the levels."""
    df, reads = spark.createDataFrame(data), spark.sparkContext.accumulator(0)

    def seen(batches):
        for p in batches:
            reads.add(len(p))
            yield p

    counted = df.withColumns({f"{c}_cut": F.col(c) for c in ["CAR_m1_p1", "NegPrepared", "NegGap", *econ.CONTROLS]}).withColumn("is_long", F.lit(True))
    econ.fit_all(counted.mapInPandas(seen, counted.schema), econ.models())
    assert reads.value == 3 * len(data)


def test_rows_of_a_firm_stand_together(spark, data):
    """So sums by firm come from one task or two; a firm with a third of the rows is cut."""
    from pathlib import Path

    home = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(home.glob("regression-*"))
    list(econ.fits(spark.createDataFrame(data).repartition(8)))
    (path,) = set(home.glob("regression-*")) - before
    files = spark.read.parquet(str(path)).select("ticker_norm", F.input_file_name().alias("file")).distinct().groupBy("ticker_norm").count().collect()
    assert sum(r["count"] > 1 for r in files) <= 4 and max(r["count"] for r in files) <= 4


def test_a_batch_without_a_whole_row(spark, data):
    bare = data.assign(CAR_m1_p1=np.nan)
    df = spark.createDataFrame(data).coalesce(1).unionByName(spark.createDataFrame(bare).coalesce(1))
    model = [econ.Model("m", "CAR_m1_p1", ("NegQA",), (), "cluster", "ticker_norm", "ticker_norm")]
    (fit,), (want,) = econ.fit_all(df, model), econ.fit_all(spark.createDataFrame(data), model)
    assert fit.n == want.n and np.allclose(fit.params, want.params) and np.allclose(fit.cov, want.cov)


@pytest.mark.parametrize("cov", ["classical", "hc1", "cluster"])
def test_one_model_like_ols(spark, data, cov):
    df = spark.createDataFrame(data)
    cluster = "ticker_norm" if cov == "cluster" else None
    (fit,), one = econ.fit_all(df, [econ.Model("m", "CAR_m1_p1", ("NegQA",), ("year_quarter",), cov, cluster)]), econ.ols(df, "CAR_m1_p1", ["NegQA"], ("year_quarter",), cov, cluster)
    assert fit.names == one.names and np.allclose(fit.params, one.params) and np.allclose(fit.cov, one.cov) and (fit.n, fit.rank, fit.clusters) == (one.n, one.rank, one.clusters)


def test_no_rows_and_refused_errors(spark, data):
    df = spark.createDataFrame(data)
    (fit,) = econ.fit_all(df.limit(0), [econ.Model("m", "CAR_m1_p1", ("NegQA",), ("year_quarter",), "cluster", "ticker_norm", "ticker_norm")])
    assert fit.n == 0 and math.isnan(fit.r2)
    with pytest.raises(ValueError, match="absorbed"):
        econ.fit_all(df, [econ.Model("m", "CAR_m1_p1", ("NegQA",), (), "hc1", None, "ticker_norm")])
