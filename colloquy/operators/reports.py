"""Tables and report lines from collected results: plain text and LaTeX."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .econ import CONTROLS, Fit

#: Names of variables in tables, order in the table of progressive specifications, texts below the tables.
NAMES = {
    "Intercept": "Constant", "NegPrepared": "Prepared Negativity", "NegGap": "Negative Gap", "NegQA": "Q&A Negativity",
    "eps_surprise": "EPS surprise", "revenue_surprise": "Revenue surprise", "log_marketCap": "Log market cap",
    "log_AvgVolume_m20_m1": "Log avg. volume", "log_n_tokens_qa": "Log Q&A length",
}
PROGRESSIVE_ORDER = ("Intercept", "NegGap", "NegPrepared", *CONTROLS)
STARS = ((0.01, "***"), (0.05, "**"), (0.1, "*"))
LEVELS = "Significance levels: *** $p<0.01$, ** $p<0.05$, * $p<0.10$."
OUTCOME = "CAR[-1,+1]"


def shown(variable: str) -> str:
    return NAMES.get(re.sub("_seg(lenw|max)$", "", variable), variable)


def missing(x: float | None) -> bool:
    return x is None or math.isnan(x)


def stars(p: float | None) -> str:
    return "" if missing(p) else next((mark for most, mark in STARS if p < most), "")


def with_stars(b: float | None, p: float | None) -> str:
    return "" if missing(b) else f"{b:.4f}{stars(p)}"


def p_value(p: float | None, latex: bool = False) -> str:
    if missing(p):
        return ""
    small = "<0.001"
    return f"{p:.3f}" if p >= 0.001 else f"${small}$" if latex else small


def latex(text: str) -> str:
    return re.sub(r"([_&%#])", r"\\\1", text)


def table_label(title: str) -> str:
    return "tab:" + re.sub("[^a-z0-9]+", "_", title.lower()).strip("_")


@dataclass
class Row:
    variable: str
    b: float
    se: float
    t: float
    p: float


def rows(fit: Fit, regressors: list[str]) -> list[Row]:
    """The constant, the regressors and the controls; NaN for what the fit doesn't have."""
    told = {n: Row(n, float(b), float(e), float(b / e) if e else math.nan, float(p)) for n, b, e, p in zip(fit.names, fit.params, fit.errors, fit.p_values())}
    none = (math.nan,) * 4
    return [told.get(v) or Row(v, *none) for v in ("Intercept", *regressors, *CONTROLS)]


def number(x: float, digits: int) -> str:
    return "nan" if missing(x) else f"{x:.{digits}f}"


def latex_table(caption: str, label: str, size: str, columns: str, blocks: list[list[list[str]]], notes: str) -> str:
    """Blocks of rows of cells between rules; the first block is the head."""
    body = "\n\\hline\n".join("\n".join(" & ".join(cells) + r" \\" for cells in block) for block in blocks)
    return "\n".join([
        r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\{size}", rf"\begin{{tabular}}{{{columns}}}", r"\hline", body, r"\hline",
        r"\end{tabular}", "", r"\vspace{0.3em}", r"\begin{minipage}{0.9\linewidth}", r"\footnotesize", rf"\textit{{Notes.}} {notes}", r"\end{minipage}", r"\end{table}",
    ])


def result_latex(title: str, fit: Fit, regressors: list[str]) -> str:
    head = ["Variable", "Coef.", "Std. Err.", "t-stat", "p-value"]
    body = [[latex(shown(r.variable)), with_stars(r.b, r.p), number(r.se, 4), number(r.t, 2), p_value(r.p, True)] for r in rows(fit, regressors)]
    notes = f"$N = {fit.n:,}$, $R^2 = {fit.r2:.3f}$, adjusted $R^2 = {fit.adjusted_r2:.3f}$. Covariance estimator: {latex(fit.kind)}. {LEVELS}"
    return latex_table(f"{latex(title)} | {OUTCOME}", table_label(title), "small", "lrrrr", [[head], body], notes)


def wald_latex(hypothesis: str, wald: dict) -> str:
    head = ["Hypothesis", "Coef. diff.", "Std. Err.", "t-stat", "p-value"]
    body = [latex(hypothesis), with_stars(wald["diff"], wald["p"]), number(wald["se"], 4), number(wald["t"], 2), p_value(wald["p"], True)]
    return latex_table("Wald test on main outcome", "tab:wald_main_outcome", "small", "lrrrr", [[head], [body]], LEVELS)


def progressive_latex(fits: list[tuple[str, Fit]]) -> str:
    """Three rows per variable that any fit has: coefficients, errors, p-values; then the size and fit of each."""
    told = [{r.variable: r for r in rows(f, [v for v in PROGRESSIVE_ORDER if v.startswith("Neg")])} for _, f in fits]
    body = []
    for v in PROGRESSIVE_ORDER:
        own = [t[v] for t in told]
        if any(not missing(r.b) for r in own):
            body.append([latex(shown(v)), *[with_stars(r.b, r.p) for r in own]])
            body.append(["", *["" if missing(r.se) else f"({r.se:.4f})" for r in own]])
            body.append(["p-value", *[p_value(r.p, True) for r in own]])
    sizes = [["Observations", *[f"{f.n:,}" for _, f in fits]], ["$R^2$", *[f"{f.r2:.3f}" for _, f in fits]], ["Adj. $R^2$", *[f"{f.adjusted_r2:.3f}" for _, f in fits]]]
    notes = (
        "The dependent variable is cumulative abnormal return over the $[-1,+1]$ window around the call date. "
        f"Clustered standard errors at the firm level are reported in parentheses. {LEVELS}"
    )
    return latex_table("Progressive specifications", "tab:progressive_specs", "scriptsize", "l" + "c" * len(fits), [[["Variable", *[latex(t) for t, _ in fits]]], body, sizes], notes)


def result_text(title: str, fit: Fit, regressors: list[str]) -> str:
    rule = "-" * 86
    head = f"{'Variable':41}{'Coef.':14}{'Std.Err.':12}{'t-stat':9}p-value"
    body = [f"{shown(r.variable):35}{with_stars(r.b, r.p):14}{number(r.se, 4):>12}{number(r.t, 2):>10}{p_value(r.p):>10}" for r in rows(fit, regressors)]
    sizes = f"N = {fit.n:,}   R-squared = {fit.r2:.3f}   Adj. R-squared = {fit.adjusted_r2:.3f}"
    return "\n".join([f"{title} | {OUTCOME}", head, rule, *body, rule, sizes, f"Covariance: {fit.kind}", "Significance: *** p<0.01, ** p<0.05, * p<0.10"])


def stats_line(stats: dict, percent: bool = False) -> str:
    """One line from a row of ``describe.summary``."""
    def told(x: float) -> str:
        return f"{100 * x:,.2f}%" if percent else f"{x:,.2f}"

    names = {"mean": "mean", "std": "std", "min": "min", "p25": "p25", "p50": "median", "p75": "p75", "max": "max"}
    return " | ".join([f"count={int(stats['n']):,}", *[f"{name}={told(float(stats[k] if stats[k] is not None else math.nan))}" for k, name in names.items()]])
