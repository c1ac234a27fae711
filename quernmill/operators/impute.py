"""Filling missing values by chained equations, with masks and residual variation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernmill.operators.names import fresh
from quernmill.session import cut

_SHRINK = 10.0  # a group mean counts the overall mean as so many rows


def usable(column: str, low: float, high: float) -> Column:
    """True for a number in [low, high]; null, NaN and infinities are none."""
    c = F.col(f"`{column}`").cast("double")
    return F.coalesce(~F.isnan(c) & (c >= low) & (c <= high), F.lit(False))


def _uniform(*salt: object) -> str:
    texts = ", ".join(f"'{x}'" for x in salt)
    return f"((xxhash64(__key, {texts}) & {(1 << 53) - 1}) + 0.5D) / {1 << 53}"


def _normal(*salt: object) -> str:
    return f"sqrt(-2 * ln({_uniform(*salt, 'r')})) * cos({2 * math.pi!r}D * {_uniform(*salt, 'a')})"


class _Fit:
    """Least-squares fits of all numbers that lack values, from one aggregate: on the other numbers and on the means of each class.

    Expressions are SQL text on names of our own: one analysis for each step, however many moments there are.
    """

    def __init__(self, work: DataFrame, targets: list[str], numbers: list[str], classes: list[str], means: dict[str, float]):
        self.targets, self.work = targets, work
        self.inputs = {y: ["1D", *[c for c in numbers if c != y], *[f"m_{g}_{y}" for g in classes]] for y in targets}
        for g in classes if targets else ():
            stats = [F.expr(f"sum(CASE WHEN NOT {y}_filled THEN {y} END) AS s_{y}") for y in targets] + [F.expr(f"count_if(NOT {y}_filled) AS k_{y}") for y in targets]
            # a row's own value is not held against it
            own = {y: f"CAST(NOT {y}_filled AND {g} IS NOT NULL AS INT)" for y in targets}
            like = [f"(coalesce(s_{y}, 0D) - {own[y]} * {y} + {_SHRINK * means[y]!r}D) / (coalesce(k_{y}, 0) - {own[y]} + {_SHRINK}D) AS m_{g}_{y}" for y in targets]
            self.work = self.work.join(work.groupBy(g).agg(*stats).where(f"{g} IS NOT NULL"), g, "left").selectExpr(*self.work.columns, *like)
        self.weights = self._solve() if targets else {}

    def _solve(self) -> dict[str, tuple[np.ndarray, float]]:
        moments, out, at = [], {}, 0
        for y in self.targets:
            x = [*self.inputs[y], y]
            moments += [f"sum(CASE WHEN NOT {y}_filled THEN CAST({x[i]} * {x[j]} AS DOUBLE) END)" for i in range(len(x)) for j in range(i, len(x))]
        got = [float(v) for v in self.work.selectExpr(*[f"{m} AS v{i}" for i, m in enumerate(moments)]).head()]
        for y in self.targets:
            n = len(self.inputs[y]) + 1
            full = np.zeros((n, n))
            for i in range(n):
                for j in range(i, n):
                    full[i, j] = full[j, i] = got[at]
                    at += 1
            gram, cross, square, rows = full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0]
            scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
            beta = np.linalg.lstsq(gram / np.outer(scale, scale) + 1e-9 * np.eye(n - 1), cross / scale, rcond=None)[0] / scale
            out[y] = beta, math.sqrt(max(0.0, (square - 2 * beta @ cross + beta @ gram @ beta) / max(rows - n + 1, 1)))
        return out

    def expected(self, y: str) -> str:
        return "(" + " + ".join(f"{float(b)!r}D * {x}" for b, x in zip(self.weights[y][0], self.inputs[y], strict=True)) + ")"

    def drawn(self, y: str, bounds: tuple[float, float], salt: tuple) -> str:
        guess = f"{self.expected(y)} + {self.weights[y][1]!r}D * {_normal(*salt)}"
        return f"CASE WHEN {y}_filled THEN greatest(least({guess}, {float(bounds[1])!r}D), {float(bounds[0])!r}D) ELSE {y} END"


def _bins(edges: dict[str, list[float]], groups: list[str]) -> str:
    """An array: the place of each number between its edges, each class, and `all`, which every row has."""
    binned = ["concat('" + c + ":', " + " + ".join(["0", *[f"CAST({c} > {e!r}D AS INT)" for e in steps]]) + ")" for c, steps in edges.items()]
    return "array(" + ", ".join([*binned, *[f"concat('{g}=', coalesce({g}, ''))" for g in groups], "'all'"]) + ")"


def _ladders(work: DataFrame, target: str, bins: str, n_bins: int, total: int) -> DataFrame:
    """bins_<target>, ladder_<target>: for each combination of bins in a row that lacks `target`, the classes with their cumulated chances by naive Bayes.

    The counts of each class with each bin are one aggregate over the rows that have a class;
    the bin `all` holds the sizes. Each count is smoothed by one row of the bin's overall
    rate, so a bin that a class has never been seen with changes nothing but for its size.
    """
    held = work.where(f"NOT {target}_filled").selectExpr(f"{target} AS c", f"explode({bins}) AS b").groupBy("c", "b").agg(F.count("*").alias("n"))
    combos = work.where(f"{target}_filled").selectExpr(f"{bins} AS bins").distinct()
    text = f"""
WITH held AS (SELECT * FROM {{held}}), combos AS (SELECT * FROM {{combos}}),
whole AS (SELECT b, sum(n) / {float(total)!r}D AS rate FROM held GROUP BY b),
weights AS (SELECT b, c, CASE WHEN b = 'all' THEN ln(n) - {n_bins} * ln(n + 1) ELSE ln(n + rate) - ln(rate) END AS w FROM held JOIN whole USING (b)),
votes AS (SELECT bins, c, sum(w) AS w FROM (SELECT bins, explode(bins) AS b FROM combos) JOIN weights USING (b) GROUP BY bins, c),
chance AS (SELECT bins, c, exp(w - max(w) OVER (PARTITION BY bins)) AS p FROM votes),
steps AS (SELECT bins, c, sum(p) OVER (PARTITION BY bins ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(p) OVER (PARTITION BY bins) AS at FROM chance)
SELECT bins AS bins_{target}, sort_array(collect_list(struct(at, c))) AS ladder_{target} FROM steps GROUP BY bins"""
    return work.sparkSession.sql(text, held=held, combos=combos)


def chained_impute(df: DataFrame, key: str, *, numeric: dict[str, tuple[float, float]], categorical: list[str] = (), predictors: list[str] = (), rounds: int = 3, seed: int = 5, expected: bool = False) -> DataFrame:
    """df with every numeric and categorical field complete, and `<field>_filled` marks.

    numeric: field -> (low, high); null, NaN, infinite and outside values are missing.
    categorical: fields of which null and blank values are missing. predictors: further
    columns, used where they are numbers and at their mean elsewhere, and kept as they are.

    Missing values start at the mean or the most frequent class. In each of `rounds` rounds
    every field that lacks values is fitted on the rows that have it from all others, as the
    last round left them: a number by least squares on the other numbers and on the means of
    its classes (normal equations of all numbers in one aggregate of fixed size), a class by
    naive Bayes over numbers binned at their first quintiles and the other classes. All fields
    are then filled in one projection, written once a round. A missing value is a draw: prediction plus a
    normal residual of the fit's spread, clamped to the range, or a class by its probability.
    Draws hang on the hash of key, field and seed, so they are the same in any partitioning.
    With `expected` a column `<field>_expected` holds the last round's prediction of each number, before its draw.

    Given values never change. Rows with a null key are filled as well (with one draw for all
    of them); repeated keys are rows of their own. A field without any value is filled with
    the middle of its range; a class without any stays null. An empty table stays empty.
    Other columns pass through; where one has a mark's name, the mark gets underscores appended.
    """
    given = df.columns
    fields = {c: f"n{i}" for i, c in enumerate(numeric)} | {c: f"c{i}" for i, c in enumerate(categorical)}
    bounds = {fields[c]: b for c, b in numeric.items()}
    numbers, classes, extra = list(bounds), [fields[c] for c in categorical], [f"p{i}" for i in range(len(predictors))]
    # own names for all that is worked on; the other columns travel in one struct
    rest = [c for c in given if c not in fields]
    columns = [F.col(f"`{key}`").cast("string").alias("__key"), F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)], F.lit(0).alias("end")).alias("rest")]
    for c, (low, high) in numeric.items():
        ok = usable(c, low, high)
        columns += [(~ok).alias(f"{fields[c]}_filled"), F.when(ok, F.col(f"`{c}`").cast("double")).alias(fields[c])]
    for c in categorical:
        ok = F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False))
        columns += [(~ok).alias(f"{fields[c]}_filled"), F.when(ok, F.col(f"`{c}`")).alias(fields[c])]
    columns += [F.when(usable(c, -1e300, 1e300), F.col(f"`{c}`").cast("double")).alias(p) for c, p in zip(predictors, extra, strict=True)]
    work = cut(df.select(*columns))
    first = work.agg(*[F.avg(c).alias(c) for c in (*numbers, *extra)], *[F.count_if(f"{c}_filled").alias(f"{c}_filled") for c in (*numbers, *classes)], *[F.mode(c).alias(c) for c in classes], F.count("*").alias("rows")).head()
    middle = {c: sum(b) / 2 for c, b in bounds.items()}
    starts = {c: first[c] if first[c] is not None else middle.get(c, 0.0) for c in (*numbers, *extra)} | {c: first[c] for c in classes if first[c] is not None}
    work = work.fillna(starts) if starts else work
    lacking = [c for c in numbers if first[f"{c}_filled"] and first[c] is not None]
    # a number without any value stays at the middle, a class without any null
    drawn = [c for c in classes if first[f"{c}_filled"] and first[c] is not None]
    inputs = [*numbers, *extra]
    known = {c: first["rows"] - first[f"{c}_filled"] for c in classes}
    edges = {c: sorted(set(e)) for c, e in zip(inputs, work.approxQuantile(inputs, [0.2, 0.4, 0.6, 0.8], 0.01), strict=True)} if drawn and inputs else {}
    for k in range(rounds if lacking or drawn else 0):
        fit = _Fit(work, lacking, inputs, classes, first)
        step, filled = fit.work, {c: fit.drawn(c, bounds[c], (seed, c)) for c in lacking}
        for c in drawn:
            groups = [g for g in classes if g != c]
            bins = _bins(edges, groups)
            ladder = _ladders(work, c, bins, len(edges) + len(groups), known[c])
            step = step.join(ladder, F.expr(f"CASE WHEN {c}_filled THEN {bins} END") == F.col(f"bins_{c}"), "left").withColumn(f"start_{c}", F.lit(first[c]))
            filled[c] = f"CASE WHEN {c}_filled THEN coalesce(get(filter(ladder_{c}, x -> x.at >= {_uniform(seed, c)}), 0).c, start_{c}) ELSE {c} END"
        shown = [f"{fit.expected(c)} AS {c}_expected" for c in lacking] if expected and k == rounds - 1 else []
        work = cut(step.selectExpr(*[f"{filled[c]} AS {c}" if c in filled else c for c in work.columns], *shown))
    place = {c: i for i, c in enumerate(rest)}
    out, taken = [F.col(fields[c]).alias(c) if c in fields else F.col(f"rest.r{place[c]}").alias(c) for c in given], list(given)
    for c in (*numeric, *categorical):
        taken.append(fresh(f"{c}_filled", taken))
        out.append(F.col(f"{fields[c]}_filled").alias(taken[-1]))
    for c in numeric if expected else ():
        taken.append(fresh(f"{c}_expected", taken))
        out.append((F.col(f"{fields[c]}_expected") if fields[c] in lacking else F.lit(None).cast("double")).alias(taken[-1]))
    return work.select(*out)
