"""SQL for the queries of the catalog, written apart from the operators: plain SQL, and recursive SQL for solves and eigenvalues.

Two recursions do what the kernels do with NumPy: Gauss-Jordan elimination on a matrix kept as a list of rows, and cyclic Jacobi
rotations on a symmetric matrix and its eigenvectors.
"""

from __future__ import annotations

from ..sources import panels
from .catalog import GRID_STEP, GRID_WINDOWS, HORIZON, KINDS, PATCH, REPS, SAMPLE_SPECS, STEP, STRENGTH, WINDOWS, M

TRANSFORMS = {"absolute": "vol - prev", "relative": "(vol - prev) / greatest(prev, 1e-8)", "log_relative": "ln(greatest(vol, 1e-8)) - ln(greatest(prev, 1e-8))"}
BOOK = "book AS (SELECT CAST((l_linenumber - 1) * 4 + l_partkey % 4 AS INTEGER) AS bucket, sum(l_quantity * (l_discount - 0.05)) AS vega FROM lineitem GROUP BY 1)"
GRID = "grid AS (SELECT CAST(e.range + 1 AS VARCHAR) || 'Y' AS expiry, CAST(t.range + 1 AS VARCHAR) || 'Y' AS tenor, CAST(e.range AS INTEGER) AS e_idx, CAST(t.range AS INTEGER) AS t_idx, CAST(e.range * 4 + t.range AS INTEGER) AS bucket, CAST(e.range + 1 AS DOUBLE) AS e_years, CAST(t.range + 1 AS DOUBLE) AS t_years FROM range(7) e, range(4) t)"
EMBEDDINGS = "source AS (SELECT vec_id AS t, CAST(k.range AS INTEGER) AS bucket, CAST(embedding[k.range + 1] AS DOUBLE) AS x FROM embeddings, range(64) k)"
LABEL_OF = "CAST(bucket // 4 + 1 AS VARCHAR) || 'Y' AS expiry, CAST(bucket % 4 + 1 AS VARCHAR) || 'Y' AS tenor"


def r(expression: str, name: str = "", digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def moves(transform: str = "absolute", grain: str = "month") -> str:
    return f"""cells AS (SELECT CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date, (l_linenumber - 1) * 4 + l_partkey % 4 AS bucket, avg(l_extendedprice) / 1000 AS vol FROM lineitem GROUP BY 1, 2),
    days AS (SELECT DISTINCT date FROM cells),
    dense AS (SELECT d.date, CAST(b.range AS INTEGER) AS bucket, c.vol FROM days d CROSS JOIN range(28) b LEFT JOIN cells c ON c.date = d.date AND c.bucket = b.range),
    lagged AS (SELECT date, bucket, vol, lag(vol) OVER (PARTITION BY bucket ORDER BY date) AS prev FROM dense),
    raw AS (SELECT date, bucket, vol - prev AS dvol, prev, {TRANSFORMS[transform]} AS x FROM lagged WHERE vol IS NOT NULL AND prev IS NOT NULL),
    whole AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM raw GROUP BY date HAVING count(*) = 28),
    moves AS (SELECT t, date, bucket, x, dvol, prev FROM raw JOIN whole USING (date))"""


PANEL = moves() + ", source AS (SELECT t, bucket, x FROM moves)"
CENTRED = "cen AS (SELECT t, bucket, x - avg(x) OVER (PARTITION BY bucket) AS x FROM source)"
COV = CENTRED + ", cov AS (SELECT a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM cen a JOIN cen b USING (t) GROUP BY 1, 2)"


def two_way(expiries: int, tenors: int) -> str:
    return f"""{CENTRED}, cube AS (SELECT t, bucket // {tenors} AS e, bucket % {tenors} AS m, x FROM cen), size AS (SELECT greatest(count(DISTINCT t) - 1, 1) AS n FROM cen),
    ce AS (SELECT a.e AS i, b.e AS j, sum(a.x * b.x) / {tenors} / any_value(n) AS c FROM cube a JOIN cube b USING (t, m), size GROUP BY 1, 2),
    ct AS (SELECT a.m AS i, b.m AS j, sum(a.x * b.x) / {expiries} / any_value(n) AS c FROM cube a JOIN cube b USING (t, e), size GROUP BY 1, 2)"""


def jacobi(name: str, source: str, p: int, sweeps: int = 10) -> str:
    """CTEs: {name}(g, rk, lam, vec), eigenvalues from the largest down and their vectors, of the matrices ``source`` (g, i, j, c)."""
    pairs = p * (p - 1) // 2
    rotate = "list_transform({0}, lambda w: list_transform(w, lambda x, j: CASE WHEN j = p THEN c * x - s * w[q] WHEN j = q THEN s * w[p] + c * x ELSE x END))"
    return f"""{name}_start AS (SELECT g, list(line ORDER BY i) AS m FROM (SELECT g, i, list(c ORDER BY j) AS line FROM {source} GROUP BY g, i) GROUP BY g),
    {name}_pairs AS (SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS k, a.range + 1 AS p, b.range + 1 AS q FROM range({p}) a, range({p}) b WHERE a.range < b.range),
    {name}_run(g, n, m, v) AS (
      SELECT g, CAST(0 AS BIGINT), m, list_transform(range({p}), lambda a: list_transform(range({p}), lambda b: CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) FROM {name}_start
      UNION ALL
      SELECT g, n + 1, list_transform(m1, lambda w, i: CASE WHEN i = p THEN list_transform(w, lambda x, j: c * x - s * m1[q][j]) WHEN i = q THEN list_transform(w, lambda x, j: s * m1[p][j] + c * x) ELSE w END), v1
      FROM (SELECT g, n, p, q, c, s, {rotate.format("m")} AS m1, {rotate.format("v")} AS v1
        FROM (SELECT *, 1 / sqrt(tan * tan + 1) AS c, tan / sqrt(tan * tan + 1) AS s
          FROM (SELECT *, CASE WHEN th IS NULL THEN 0 WHEN th >= 0 THEN 1 / (th + sqrt(th * th + 1)) ELSE -1 / (sqrt(th * th + 1) - th) END AS tan
            FROM (SELECT u.*, p, q, (m[q][q] - m[p][p]) / (2 * nullif(m[p][q], 0)) AS th FROM {name}_run u JOIN {name}_pairs ON k = n % {pairs} WHERE n < {sweeps * pairs})))))
    , {name} AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY m[col][col] DESC) AS rk, m[col][col] AS lam, list_transform(v, lambda w: w[col]) AS vec FROM {name}_run, (SELECT range + 1 AS col FROM range({p})) WHERE n = {sweeps * pairs})"""


def recursive(*parts: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def plain(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


# ---- factor models --------------------------------------------------------------------------------

#: train(g, t, bucket, x) and test(g, t, date, bucket, x, dvol) of one model on all months, and of the walk-forward folds.
ALL_ROWS = "train AS (SELECT 0 AS g, t, bucket, x FROM moves), test AS (SELECT 0 AS g, t, date, bucket, x, dvol FROM moves)"
LAST_ROWS = "train AS (SELECT 0 AS g, t, bucket, x FROM moves WHERE t >= (SELECT count(*) - 40 FROM whole)), test AS (SELECT 0 AS g, t, date, bucket, x, dvol FROM moves WHERE t >= (SELECT count(*) - 40 FROM whole))"
FOLDS = f"""folds AS (SELECT w.w * 1000 + f.range AS g, w.w, f.range AS f, w.w + {STEP} * f.range AS start FROM (SELECT unnest({list(WINDOWS)}) AS w) w, range(100) f WHERE w.w + {STEP} * f.range < (SELECT count(*) FROM whole)),
    train AS (SELECT g, t, bucket, x FROM folds JOIN moves ON t >= start - w AND t < start),
    test AS (SELECT g, t, date, bucket, x, dvol FROM folds JOIN moves ON t >= start AND t < start + {HORIZON})"""


def pca(rows: str, keep: int = 3) -> tuple[str, ...]:
    """mean, load(g, rk, bucket, w), price(g, rk, y), score(g, t, rk, s), base(g, b) and full_pnl(g, t, date, full_pnl)."""
    return (
        moves(), BOOK, rows,
        "mean AS (SELECT g, bucket, avg(x) AS mu FROM train GROUP BY 1, 2)",
        "dev AS (SELECT g, t, bucket, x - mu AS x FROM train JOIN mean USING (g, bucket))",
        "fcov AS (SELECT a.g, a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM dev a JOIN dev b USING (g, t) GROUP BY 1, 2, 3)",
        jacobi("eig", "fcov", 28),
        f"load AS (SELECT g, rk, CAST(b.range AS INTEGER) AS bucket, vec[b.range + 1] AS w FROM eig, range(28) b WHERE rk <= {keep})",
        "price AS (SELECT g, rk, sum(w * vega) AS y FROM load JOIN book USING (bucket) GROUP BY 1, 2)",
        "score AS (SELECT test.g, t, rk, sum((x - mu) * w) AS s FROM test JOIN mean USING (g, bucket) JOIN load USING (g, bucket) GROUP BY 1, 2, 3)",
        "base AS (SELECT g, sum(mu * vega) AS b FROM mean JOIN book USING (bucket) GROUP BY 1)",
        "fullp AS (SELECT g, t, date, sum(dvol * vega) AS full_pnl FROM test JOIN book USING (bucket) GROUP BY 1, 2, 3)",
        "ks AS (SELECT unnest([1, 2, 3]) AS k)",
        "pred AS (SELECT g, k, t, any_value(date) AS date, any_value(full_pnl) AS full_pnl, any_value(b) + sum(s * y) AS projected_pnl FROM score JOIN price USING (g, rk) JOIN base USING (g) JOIN fullp USING (g, t), ks WHERE rk <= k GROUP BY 1, 2, 3)",
        # dvol - dvol_hat of two factors
        "hat AS (SELECT test.g, t, bucket, dvol, mu + sum(s * w) AS hat FROM test JOIN mean USING (g, bucket) JOIN load USING (g, bucket) JOIN score USING (g, t, rk) WHERE rk <= 2 GROUP BY test.g, t, bucket, dvol, mu)")


METRICS = ", ".join([
    "count(*) AS n_test_obs", *(r(e, n, 4) for n, e in {
        "full_pnl_std": "stddev_samp(full_pnl)", "proj_pnl_std": "stddev_samp(projected_pnl)", "error_mean": "avg(error)", "error_rmse": "sqrt(avg(error * error))", "error_mae": "avg(abs(error))",
        "error_p95_abs": "quantile_cont(abs(error), 0.95)", "error_max_abs": "max(abs(error))", "explained_pnl_variance": "1 - var_samp(error) / var_samp(full_pnl)", "full_vs_projected_corr": "corr(full_pnl, projected_pnl)"}.items())])
MODEL = "'Abs PCA sample k=' || k AS model, CAST(g // 1000 AS INTEGER) AS \"window\""
SUMMED = f'summary AS (SELECT model, "window", {METRICS}, sqrt(avg(error * error)) AS rmse, quantile_cont(abs(error), 0.95) AS p95, 1 - var_samp(error) / var_samp(full_pnl) AS explained FROM preds GROUP BY 1, 2)'
WALK = (*pca(FOLDS), f"preds AS (SELECT {MODEL}, CAST(g % 1000 AS INTEGER) AS fold, t, date, full_pnl, projected_pnl, full_pnl - projected_pnl AS error FROM pred)")
SUMMARY = (*WALK, SUMMED)

#: Values of one kind of model: how moves become x (0 absolute, 1 relative, 2 log), the power of the book's weights, the estimator and its alpha.
Kind = tuple[int, float, str, float]
TO_X = "CASE tr WHEN 0 THEN vol - prev WHEN 1 THEN (vol - prev) / greatest(prev, 1e-8) ELSE ln(greatest(vol, 1e-8)) - ln(greatest(prev, 1e-8)) END"


def kinds_of(specs: list) -> dict[Kind, list]:
    """Specs by kind; Ledoit-Wolf and OAS only move eigenvalues and correlation shrinkage equals diagonal shrinkage, so these share a kind."""
    found: dict[Kind, list] = {}
    same = {"ledoit_wolf": "sample", "oas": "sample", "correlation_shrink": "diagonal_shrink"}
    for s in specs:
        if s.family == "pca":
            kind = (("absolute", "relative", "log_relative").index(s.transform), s.vega_weight_power, same.get(s.covariance_method, s.covariance_method), s.shrinkage_alpha)
            found.setdefault(kind, []).append(s)
    return found


def grid_walk(specs: list) -> tuple[str, ...]:
    """preds of all the specs over the walk-forward grid: one eigenproblem a kind and fold. g numbers kind (millions), window (thousands) and fold."""
    kinds = kinds_of(specs) or {(0, 0.0, "sample", 0.0): []}  # two-way models take absolute, even rows
    rows = ", ".join(f"({i}, {tr}, CAST({power} AS DOUBLE), '{method}', CAST({alpha} AS DOUBLE))" for i, (tr, power, method, alpha) in enumerate(kinds))
    names = ", ".join(f"({i}, {s.n_components}, '{s.name}')" for i, own in enumerate(kinds.values()) for s in own) or "(NULL, NULL, NULL)"
    pairs = [s for s in specs if s.family == "separable"]
    parts = [
        moves(), BOOK, f"kind AS (SELECT * FROM (VALUES {rows}) v(kd, tr, power, method, alpha))", f"named AS (SELECT * FROM (VALUES {names}) v(kd, k, model))",
        f"folds AS (SELECT w.w * 1000 + f.range AS f, w.w, w.w + {GRID_STEP} * f.range AS start FROM (SELECT unnest({list(GRID_WINDOWS)}) AS w) w, range(100) f WHERE w.w + {GRID_STEP} * f.range < (SELECT count(*) FROM whole))",
        "scale AS (SELECT median(abs(vega)) AS s FROM book WHERE abs(vega) > 1e-8)",
        "weight AS (SELECT kd, bucket, CASE WHEN power = 0 THEN 1.0 ELSE least(greatest(power((abs(vega) + 1e-8) / (s + 1e-8), power), 0.1), 5.0) END AS w FROM kind, book, scale)",
        "levels AS (SELECT t, date, bucket, dvol, prev, prev + dvol AS vol FROM moves)",
        f"x AS (SELECT kd, t, date, bucket, {TO_X} AS x, dvol, prev, tr FROM kind, levels)",
        "train AS (SELECT kd * 1000000 + f AS g, kd, t, bucket, x * w.w AS x FROM folds JOIN x ON t >= start - folds.w AND t < start JOIN weight w USING (kd, bucket))",
        f"test AS (SELECT kd * 1000000 + f AS g, kd, t, date, bucket, x * w.w AS x, dvol, prev, tr, w.w AS w FROM folds JOIN x ON t >= start AND t < start + {GRID_STEP} JOIN weight w USING (kd, bucket))",
        "mean AS (SELECT g, bucket, avg(x) AS mu FROM train GROUP BY 1, 2)", "dev AS (SELECT g, t, bucket, x - mu AS x FROM train JOIN mean USING (g, bucket))",
        "scov AS (SELECT a.g, a.g // 1000000 AS kd, a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM dev a JOIN dev b USING (g, t) GROUP BY 1, 2, 3, 4)"]
    methods = {m for _, _, m, _ in kinds}
    blend = "SELECT g, i, j, CASE WHEN method = 'diagonal_shrink' AND i <> j THEN c * (1 - alpha) ELSE c END AS c FROM scov JOIN kind USING (kd) WHERE method IN ('sample', 'diagonal_shrink')"
    if "separable_shrink" in methods:
        parts += [
            "sdev AS (SELECT g, t, bucket // 4 AS e, bucket % 4 AS m, x FROM dev JOIN kind ON kd = g // 1000000 WHERE method = 'separable_shrink')", "sn AS (SELECT g, count(DISTINCT t) - 1 AS n FROM sdev GROUP BY 1)",
            "ske AS (SELECT g, a.e AS i, b.e AS j, sum(a.x * b.x) / 4 / any_value(n) AS c FROM sdev a JOIN sdev b USING (g, t, m) JOIN sn USING (g) GROUP BY 1, 2, 3)", "skt AS (SELECT g, a.m AS i, b.m AS j, sum(a.x * b.x) / 7 / any_value(n) AS c FROM sdev a JOIN sdev b USING (g, t, e) JOIN sn USING (g) GROUP BY 1, 2, 3)",
            "kron AS (SELECT g, a.i * 4 + b.i AS i, a.j * 4 + b.j AS j, a.c * b.c AS d FROM ske a JOIN skt b USING (g))", "ratio AS (SELECT g, sum(c) / sum(d) AS q FROM scov JOIN kron USING (g, i, j) WHERE i = j GROUP BY 1)"]
        blend += " UNION ALL SELECT g, i, j, (1 - alpha) * c + alpha * q * d FROM scov JOIN kind USING (kd) JOIN kron USING (g, i, j) JOIN ratio USING (g)"
    if "factor_diag" in methods:
        parts += [
            "fd AS (SELECT g, i, j, c FROM scov JOIN kind USING (kd) WHERE method = 'factor_diag')", jacobi("feig", "fd", 28),
            "common AS (SELECT g, a.range AS i, b.range AS j, sum(greatest(lam, 0) * vec[a.range + 1] * vec[b.range + 1]) AS h FROM feig, range(28) a, range(28) b WHERE rk <= 3 GROUP BY 1, 2, 3)"]
        blend += " UNION ALL SELECT g, i, j, (1 - alpha) * c + alpha * CASE WHEN i = j THEN h + greatest(c - h, 1e-12) ELSE h END FROM scov JOIN kind USING (kd) JOIN common USING (g, i, j)"
    hat = "CASE tr WHEN 2 THEN prev * (exp(h) - 1) WHEN 1 THEN prev * h ELSE h END"
    parts += [
        f"est AS ({blend})", jacobi("eig", "est", 28), "load AS (SELECT g, rk, CAST(b.range AS INTEGER) AS bucket, vec[b.range + 1] AS v FROM eig, range(28) b WHERE rk <= 10)",
        "score AS (SELECT test.g, t, rk, sum((x - mu) * v) AS s FROM test JOIN mean USING (g, bucket) JOIN load USING (g, bucket) GROUP BY 1, 2, 3)",
        "back AS (SELECT test.g, named.model, test.t, bucket, any_value(date) AS date, any_value(dvol) AS dvol, any_value(prev) AS prev, any_value(tr) AS tr, (any_value(mu) + sum(s * v)) / any_value(w) AS h FROM test JOIN mean USING (g, bucket) JOIN load USING (g, bucket) JOIN score ON score.g = test.g AND score.t = test.t AND score.rk = load.rk JOIN named ON named.kd = test.kd AND load.rk <= named.k GROUP BY 1, 2, 3, 4)",
        f"pca_preds AS (SELECT model, CAST(g % 1000000 // 1000 AS INTEGER) AS \"window\", t, sum(dvol * vega) AS full_pnl, sum({hat} * vega) AS projected_pnl FROM back JOIN book USING (bucket) GROUP BY 1, 2, 3)"]
    all_preds = "SELECT * FROM pca_preds"
    if pairs:
        chosen = ", ".join(f"({s.r_expiry}, {s.r_tenor}, '{s.name}')" for s in pairs)
        parts += [
            f"chosen AS (SELECT * FROM (VALUES {chosen}) v(re, rt, model))", "tdev AS (SELECT g, t, bucket // 4 AS e, bucket % 4 AS m, x FROM dev WHERE g < 1000000)", "tn AS (SELECT g, count(DISTINCT t) - 1 AS n FROM tdev GROUP BY 1)",
            "tke AS (SELECT g, a.e AS i, b.e AS j, sum(a.x * b.x) / 4 / any_value(n) AS c FROM tdev a JOIN tdev b USING (g, t, m) JOIN tn USING (g) GROUP BY 1, 2, 3)", "tkt AS (SELECT g, a.m AS i, b.m AS j, sum(a.x * b.x) / 7 / any_value(n) AS c FROM tdev a JOIN tdev b USING (g, t, e) JOIN tn USING (g) GROUP BY 1, 2, 3)",
            jacobi("ee", "tke", 7), jacobi("et", "tkt", 4),
            "plane AS (SELECT g, ee.rk AS a, et.rk AS b, CAST(q.range AS INTEGER) AS bucket, ee.vec[q.range // 4 + 1] * et.vec[q.range % 4 + 1] AS v FROM ee JOIN et USING (g), range(28) q)",
            "pscore AS (SELECT test.g, t, a, b, sum((x - mu) * v) AS s FROM test JOIN mean USING (g, bucket) JOIN plane USING (g, bucket) GROUP BY 1, 2, 3, 4)", "pprice AS (SELECT g, a, b, sum(v * vega) AS y FROM plane JOIN book USING (bucket) GROUP BY 1, 2, 3)",
            "pbase AS (SELECT g, sum(mu * vega) AS base FROM mean JOIN book USING (bucket) WHERE g < 1000000 GROUP BY 1)", "pfull AS (SELECT g, t, sum(dvol * vega) AS full_pnl FROM test JOIN book USING (bucket) WHERE g < 1000000 GROUP BY 1, 2)",
            'two_preds AS (SELECT model, CAST(g // 1000 AS INTEGER) AS "window", t, any_value(full_pnl) AS full_pnl, any_value(base) + sum(s * y) AS projected_pnl FROM pscore JOIN pprice USING (g, a, b) JOIN pbase USING (g) JOIN pfull USING (g, t) JOIN chosen ON a <= re AND b <= rt GROUP BY model, g, t)']
        all_preds += " UNION ALL SELECT * FROM two_preds"
    return (*parts, f"preds AS (SELECT *, full_pnl - projected_pnl AS error FROM ({all_preds}))", SUMMED)


def spec_values(specs: list) -> str:
    """spec: the specs' fields by model."""
    rows = ", ".join(f"('{s.name}', '{s.family}', '{s.transform}', '{s.covariance_method}', {s.n_components}, {s.r_expiry}, {s.r_tenor})" for s in specs)
    return f"spec AS (SELECT * FROM (VALUES {rows}) v(model, family, transform, covariance, k, re, rt))"


SAMPLE_WALK = (*grid_walk(SAMPLE_SPECS), spec_values(SAMPLE_SPECS))
FIGURES = "n_test_obs, full_pnl_std, proj_pnl_std, error_mean, error_rmse, error_mae, error_p95_abs, error_max_abs, explained_pnl_variance, full_vs_projected_corr"
BEST = 'rmse, p95, model, "window"'
RISK = f"SELECT bucket, {LABEL_OF}, {r('vega', digits=4)}, {r('stddev_samp(dvol - hat)', 'residual_vol', 4)}, {r('abs(vega) * stddev_samp(dvol - hat)', 'residual_risk', 4)}"
TWO = (
    moves(), BOOK, "source AS (SELECT t, bucket, x FROM moves)", two_way(7, 4),
    "se AS (SELECT 0 AS g, i, j, c FROM ce)", "st AS (SELECT 0 AS g, i, j, c FROM ct)", jacobi("ee", "se", 7), jacobi("et", "st", 4),
    "pl AS (SELECT ee.rk AS a, et.rk AS b, CAST(k.range AS INTEGER) AS bucket, ee.vec[k.range // 4 + 1] * et.vec[k.range % 4 + 1] AS w FROM ee, et, range(28) k WHERE ee.rk <= 2 AND et.rk <= 2)",
    "tprice AS (SELECT a, b, sum(w * vega) AS y FROM pl JOIN book USING (bucket) GROUP BY 1, 2)", "tscore AS (SELECT t, a, b, sum(x * w) AS s FROM cen JOIN pl USING (bucket) GROUP BY 1, 2, 3)",
    "tbase AS (SELECT sum(mu * vega) AS base FROM (SELECT bucket, avg(x) AS mu FROM moves GROUP BY 1) JOIN book USING (bucket))",
    "tfull AS (SELECT t, date, sum(dvol * vega) AS full_pnl FROM moves JOIN book USING (bucket) GROUP BY 1, 2)")

WEIGHTED_ROWS = "scale AS (SELECT median(abs(vega)) AS s FROM book WHERE abs(vega) > 1e-8), weight AS (SELECT bucket, least(greatest(power((abs(vega) + 1e-8) / (s + 1e-8), 0.5), 0.1), 5.0) AS w FROM book, scale), train AS (SELECT 0 AS g, t, bucket, x * w AS x FROM moves JOIN weight USING (bucket)), test AS (SELECT 0 AS g, t, date, bucket, x * w AS x, dvol FROM moves JOIN weight USING (bucket))"
#: The chosen model fitted on its last window: bpred and bhat.
BEST_ROWS = (
    *SAMPLE_WALK, f"best AS (SELECT model, \"window\" AS w, k, CASE transform WHEN 'absolute' THEN 0 WHEN 'relative' THEN 1 ELSE 2 END AS tr FROM summary JOIN spec USING (model) ORDER BY {BEST} LIMIT 1)",
    f"brows AS (SELECT 0 AS g, t, date, bucket, {TO_X} AS x, dvol, prev, tr, k FROM levels, best WHERE t >= (SELECT count(*) FROM whole) - w)", "bmean AS (SELECT bucket, avg(x) AS mu FROM brows GROUP BY 1)", "bdev AS (SELECT t, bucket, x - mu AS x FROM brows JOIN bmean USING (bucket))",
    "bcov AS (SELECT 0 AS g, a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM bdev a JOIN bdev b USING (t) GROUP BY 2, 3)", jacobi("beig", "bcov", 28),
    "bload AS (SELECT rk, CAST(q.range AS INTEGER) AS bucket, vec[q.range + 1] AS v FROM beig, range(28) q WHERE rk <= (SELECT k FROM best))", "bscore AS (SELECT t, rk, sum(x * v) AS s FROM bdev JOIN bload USING (bucket) GROUP BY 1, 2)",
    "bh AS (SELECT t, bucket, any_value(mu) + sum(s * v) AS h FROM bscore JOIN bload USING (rk) JOIN bmean USING (bucket) GROUP BY 1, 2)",
    "bhat AS (SELECT t, date, bucket, dvol, CASE tr WHEN 2 THEN prev * (exp(h) - 1) WHEN 1 THEN prev * h ELSE h END AS hat FROM brows JOIN bh USING (t, bucket))",
    'bpred AS (SELECT model, w AS "window", t, sum(dvol * vega) AS full_pnl, sum(hat * vega) AS projected_pnl FROM bhat JOIN book USING (bucket), best GROUP BY 1, 2, 3)')

# ---- ladder ----------------------------------------------------------------------------------------


def axis(name: str, years: tuple) -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY y) - 1 AS i, y FROM (SELECT unnest([{', '.join(f'CAST({float(y)!r} AS DOUBLE)' for y in years)}]) AS y))"


def hat(name: str, points: str, nodes: str) -> str:
    return f"""{name} AS (SELECT i, k, CASE WHEN x = node THEN 1.0 WHEN x < node THEN (x - lo) / (node - lo) ELSE (hi - x) / (hi - node) END AS w
      FROM (SELECT i, least(greatest(ln(y), (SELECT ln(min(y)) FROM {nodes})), (SELECT ln(max(y)) FROM {nodes})) AS x FROM {points}),
           (SELECT i AS k, ln(y) AS node, lag(ln(y)) OVER (ORDER BY y) AS lo, lead(ln(y)) OVER (ORDER BY y) AS hi FROM {nodes})
      WHERE x = node OR x > lo AND x < node OR x > node AND x < hi)"""


NT, MT = len(panels.LADDER_TENORS), len(panels.REDUCED_TENORS)
BASIS = (
    axis("fe", panels.LADDER_EXPIRIES), axis("ft", panels.LADDER_TENORS), axis("re", panels.REDUCED_EXPIRIES), axis("rt", panels.REDUCED_TENORS), hat("he", "fe", "re"), hat("ht", "ft", "rt"),
    f"basis AS (SELECT CAST(he.i * {NT} + ht.i AS INTEGER) AS o, CAST(he.k * {MT} + ht.k AS INTEGER) AS r, he.w * ht.w AS w FROM he, ht)",
    f"fine AS (SELECT CAST((l_partkey % {len(panels.LADDER_EXPIRIES)}) * {NT} + l_suppkey % {NT} AS INTEGER) AS o, sum(l_quantity * (l_discount - 0.05)) AS v FROM lineitem GROUP BY 1)",
    "bb AS (SELECT a.r AS i, b.r AS j, sum(a.w * b.w) AS g FROM basis a JOIN basis b USING (o) GROUP BY 1, 2)", "bv AS (SELECT r AS i, sum(w * v) AS g FROM basis JOIN fine USING (o) GROUP BY 1)",
    f"sq AS (SELECT a.range AS i, b.range AS j, coalesce(g, 0.0) AS g FROM range({M}) a CROSS JOIN range({M}) b LEFT JOIN bb ON bb.i = a.range AND bb.j = b.range)")


def eliminate(name: str, start: str, steps: int) -> str:
    return f"""{name}(g, k, m) AS (SELECT g, CAST(0 AS BIGINT), m FROM {start} UNION ALL
      SELECT g, k + 1, list_transform(m, lambda w, i: CASE WHEN i = k + 1 THEN list_transform(w, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(w, lambda x, j: x - w[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM {name} WHERE k < {steps})"""


def constrained(name: str, gram: str, rhs: str, rules: int, rule_row: str, rule_value: str, groups: str = "SELECT 0 AS g") -> str:
    """{name}(g, r, v): least squares with ``gram`` (g, i, j, x) and ``rhs`` (g, i, x), under rules whose coefficient of column j is ``rule_row`` (in c and j) and value ``rule_value`` (in c)."""
    n = M + rules
    return f"""{name}_e AS (SELECT g, i, j, CASE WHEN i < {M} AND j < {M} THEN 2 * coalesce(x, 0) WHEN i < {M} AND j < {n} THEN {rule_row.format(c=f'(j - {M})', j='i')} WHEN i < {M} THEN 2 * y
        WHEN j < {M} THEN {rule_row.format(c=f'(i - {M})', j='j')} WHEN j < {n} THEN 0 ELSE 0 END AS x
      FROM (SELECT z.g, a.range AS i, b.range AS j, q.x, h.x AS y FROM ({groups}) z CROSS JOIN range({n}) a CROSS JOIN range({n + 1}) b LEFT JOIN {gram} q ON q.g = z.g AND q.i = a.range AND q.j = b.range LEFT JOIN {rhs} h ON h.g = z.g AND h.i = a.range)),
    {name}_f AS (SELECT g, i, j, CASE WHEN i >= {M} AND j = {n} THEN (SELECT val FROM ({rule_value}) WHERE c = i - {M}) ELSE x END AS x FROM {name}_e),
    {name}_s AS (SELECT g, list(line ORDER BY i) AS m FROM (SELECT g, i, list(CAST(x AS DOUBLE) ORDER BY j) AS line FROM {name}_f GROUP BY g, i) GROUP BY g),
    {eliminate(name + "_run", name + "_s", n)},
    {name} AS (SELECT g, CAST(a.range AS INTEGER) AS r, m[a.range + 1][{n + 1}] AS v FROM {name}_run, range({M}) a WHERE k = {n})"""


TOTAL = "SELECT 0 AS c, sum(v) AS val FROM fine"
ONE_GROUP = ("bb0 AS (SELECT 0 AS g, i, j, g AS x FROM bb)", "bv0 AS (SELECT 0 AS g, i, g AS x FROM bv)")
CLS = (*BASIS, *ONE_GROUP, constrained("cls", "bb0", "bv0", 1, "1", TOTAL))
RESIDUALS = (*CLS, "res AS (SELECT o, any_value(fine.v) AS v, sum(w * cls.v) AS fitted, any_value(fine.v) - sum(w * cls.v) AS residual FROM basis JOIN cls USING (r) JOIN fine USING (o) GROUP BY 1)")
INVERSE = (
    f"inv_s AS (SELECT 0 AS g, list(line ORDER BY i) AS m FROM (SELECT i, list(x ORDER BY j) AS line FROM (SELECT i, j, g AS x FROM sq UNION ALL SELECT a.range, {M} + b.range, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END FROM range({M}) a, range({M}) b) GROUP BY i))",
    eliminate("inv_run", "inv_s", M),
    f"lev AS (SELECT o, sum(a.w * b.w * m[a.r + 1][{M} + b.r + 1]) AS leverage FROM basis a JOIN basis b USING (o), inv_run WHERE k = {M} GROUP BY 1)")
SIGMA = ("bbg AS (SELECT 0 AS g, i, j, g AS c FROM sq)", jacobi("sv", "bbg", M))
#: A number by the rule of the draws, of rep and slot.
RULE = "(rep * 7919 + slot * 104729 + 12345) * 48271 % 2147483647"
SLOTS = "SELECT a.range AS rep, b.range AS slot FROM range({reps}) a, range({slots}) b"
ONE_BY_ONE = f"drawn AS (SELECT rep, CAST((z * (z % 65521 + 1) % 2147483647) % 140 AS INTEGER) AS o, count(*) AS times FROM (SELECT rep, {RULE} AS z FROM ({SLOTS.format(reps=REPS, slots=140)})) GROUP BY 1, 2)"
PATCHES = f"""starts AS (SELECT rep, z * (z % 65521 + 1) % 2147483647 % 140 AS p FROM (SELECT rep, {RULE} AS z FROM ({SLOTS.format(reps=REPS, slots=-(-14 // PATCH[0]) * -(-10 // PATCH[1]))}))),
    drawn AS (SELECT rep, CAST((p // 10 + a.range) % 14 * 10 + (p % 10 + b.range) % 10 AS INTEGER) AS o, count(*) AS times FROM starts, range({PATCH[0]}) a, range({PATCH[1]}) b GROUP BY 1, 2)"""


def bootstrap(drawn: str) -> tuple[str, ...]:
    return (
        *CLS, drawn,
        "rb AS (SELECT rep AS g, a.r AS i, b.r AS j, sum(times * a.w * b.w) AS x FROM basis a JOIN basis b USING (o) JOIN drawn USING (o) GROUP BY 1, 2, 3)",
        "rv AS (SELECT rep AS g, r AS i, sum(times * w * v) AS x FROM basis JOIN fine USING (o) JOIN drawn USING (o) GROUP BY 1, 2)",
        constrained("boot", "rb", "rv", 1, "1", TOTAL, f"SELECT range AS g FROM range({REPS})"),
        f"bare AS (SELECT g FROM (SELECT range AS g FROM range({REPS})) LEFT JOIN rb USING (g) GROUP BY g HAVING count(*) FILTER (i = j AND x > 0) < {M})",
        "bstd AS (SELECT r, stddev_pop(CASE WHEN bare.g IS NULL THEN boot.v ELSE cls.v END) AS std FROM boot JOIN cls USING (r) LEFT JOIN bare ON bare.g = boot.g GROUP BY 1)",
        "ranked AS (SELECT r, cls.v, std, CASE WHEN abs(cls.v) > 1e-6 THEN std / abs(cls.v) END AS cv FROM cls JOIN bstd USING (r))",
        "placed AS (SELECT *, row_number() OVER (ORDER BY cv ASC NULLS LAST, r) AS place FROM ranked)")


BOOTSTRAP = bootstrap(ONE_BY_ONE)
#: The coarse ladder's neighbours: diagonal counts them, others are -1.
SMOOTH = f"""near AS (SELECT a.range AS i, b.range AS j FROM range({M}) a, range({M}) b WHERE abs(a.range // {MT} - b.range // {MT}) + abs(a.range % {MT} - b.range % {MT}) = 1),
    bb0 AS (SELECT 0 AS g, i, j, g + {STRENGTH} * coalesce(d, 0) AS x FROM sq LEFT JOIN (SELECT i, j, -1 AS d FROM near UNION ALL SELECT i, i, count(*) FROM near GROUP BY i) USING (i, j))"""


def covariance(parts: tuple[str, ...], value: str = "c", extra: str = "") -> str:
    return plain(*parts, select=f"SELECT i, j, {r(value, 'c')} FROM cov{extra} WHERE i <= j")


def shrunk(method: str) -> str:
    mu, ss = "tr / p", "ss"
    share = {
        "oas": f"least(({ss} / (p * p) + {mu} * {mu}) / ((n + 1) * ({ss} / (p * p) - {mu} * {mu} / p)), 1.0)",
        "ledoit_wolf": f"least((b / n - {ss}) / (n * p), ({ss} - p * {mu} * {mu}) / p) / (({ss} - p * {mu} * {mu}) / p)"}[method]
    return plain(
        EMBEDDINGS, COV, "size AS (SELECT count(DISTINCT t) AS n, count(DISTINCT bucket) AS p FROM cen)", "s AS (SELECT i, j, c * (n - 1) / n AS s FROM cov, size)",
        "sums AS (SELECT sum(CASE WHEN i = j THEN s END) AS tr, sum(s * s) AS ss FROM s)", "fourth AS (SELECT sum(q * q) AS b FROM (SELECT sum(x * x) AS q FROM cen GROUP BY t))",
        f"known AS (SELECT {share} AS share, {mu} AS mu FROM sums, fourth, size)", select=f"SELECT i, j, {r('(1 - share) * s + CASE WHEN i = j THEN share * mu ELSE 0 END', 'c')} FROM s, known WHERE i <= j")


def oracle_sql() -> dict[str, str]:
    found = {
        "label_years": """SELECT CASE l_orderkey % 4 WHEN 0 THEN l_linenumber * 6 || 'M' WHEN 1 THEN ' ' || l_linenumber || 'y ' WHEN 2 THEN CAST(l_linenumber / 4 AS VARCHAR) ELSE l_partkey % 30 + 1 || 'Y' END AS label,
            CASE l_orderkey % 4 WHEN 0 THEN l_linenumber / 2 WHEN 1 THEN l_linenumber WHEN 2 THEN l_linenumber / 4 ELSE l_partkey % 30 + 1 END AS years, count(*) AS items FROM lineitem GROUP BY 1, 2""",
        "label_parse": """SELECT CASE l_orderkey % 4 WHEN 0 THEN l_linenumber || 'Yx' || t || 'Y' WHEN 1 THEN l_linenumber || 'Y_' || t || 'Y' WHEN 2 THEN l_linenumber * 6 || 'mX' || t || 'y' ELSE l_linenumber || 'Y_2Y_' || t || 'Y' END AS label,
            CASE l_orderkey % 4 WHEN 2 THEN l_linenumber * 6 || 'M' ELSE l_linenumber || 'Y' END AS expiry, CASE l_orderkey % 4 WHEN 3 THEN '2Y_' || t || 'Y' ELSE t || 'Y' END AS tenor, count(*) AS items
            FROM (SELECT *, l_partkey % 4 + 1 AS t FROM lineitem) GROUP BY 1, 2, 3""",
        "business_days": "SELECT row_number() OVER (ORDER BY d) - 1 AS k, d AS date FROM (SELECT CAST(unnest(range(low, high + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT CAST(CAST(min(l_shipdate) AS DATE) AS TIMESTAMP) AS low, CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP) AS high FROM lineitem)) WHERE isodow(d) < 6",
        "grid": plain(GRID, select="SELECT * FROM grid"),
        "axis_order": plain(GRID, select="SELECT expiry, CAST(min(bucket) AS BIGINT) AS first_seen FROM grid GROUP BY 1"),
        "surface_long": f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_linenumber AS VARCHAR) || 'Y' AS expiry, CAST(l_partkey % 4 + 1 AS VARCHAR) || 'Y' AS tenor, {r('avg(l_extendedprice) / 1000', 'vol')} FROM lineitem GROUP BY 1, 2, 3",
        "surface_matrix": "SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, CAST(l_linenumber AS VARCHAR) || 'Y' AS expiry, " + ", ".join(f"""round(avg(l_extendedprice) FILTER (l_partkey % 4 = {i}) / 1000, 6) AS "{i + 1}Y" """ for i in range(4)) + "FROM lineitem GROUP BY 1, 2",
        "missing_cells": plain(moves(), select="SELECT date, bucket FROM dense WHERE vol IS NULL"),
        **{f"moves_{k}": plain(moves(t), select=f"SELECT t, date, bucket, {r('x')}, {r('dvol')}, {r('prev')} FROM moves") for k, t in (("abs", "absolute"), ("rel", "relative"), ("log", "log_relative"))},
        "moves_inverse": " UNION ALL ".join(f"SELECT * FROM ({plain(moves(t), select=f'''SELECT '{t}' AS transform, date, bucket, {r('prev * x' if t == 'relative' else 'prev * (exp(x) - 1)', 'exact')}, {r('prev * x', 'linear')} FROM moves''')})" for t in ("relative", "log_relative")),
        "vega_align": plain(GRID, BOOK, select=f"SELECT bucket, expiry, tenor, {r('coalesce(vega, 0)', 'vega')}, vega IS NULL AS missing FROM grid LEFT JOIN book USING (bucket)"),
        "vega_align_missing": plain(GRID, BOOK, select=f"SELECT bucket, expiry, tenor, {r('CASE WHEN t_idx = 3 THEN 0 ELSE vega END', 'vega')}, t_idx = 3 AS missing FROM grid LEFT JOIN book USING (bucket)"),
        **{f"vega_weights_p{int(100 * p)}": plain(BOOK, select=f"SELECT bucket, {r(f'least(greatest(power((abs(vega) + 1e-8) / ((SELECT median(abs(vega)) FROM book WHERE abs(vega) > 1e-8) + 1e-8), {p}), 0.1), 5.0)', 'weight')} FROM book") for p in (0.25, 0.5, 1.0)},
        "full_pnl": plain(moves(), BOOK, select=f"SELECT t, date, {r('sum(dvol * vega)', 'full_pnl')} FROM moves JOIN book USING (bucket) GROUP BY 1, 2"),
        "cov_sample": covariance((EMBEDDINGS, COV)),
        "cov_sample_panel": covariance((PANEL, COV)),
        "cov_diag_shrink": covariance((PANEL, COV), "CASE WHEN i = j THEN c ELSE 0.7 * c END"),
        "cov_corr_shrink": covariance((PANEL, COV, "sd AS (SELECT i AS k, sqrt(greatest(c, 1e-16)) AS s FROM cov WHERE i = j)"), "(0.7 * c / (a.s * b.s) + CASE WHEN i = j THEN 0.3 ELSE 0 END) * a.s * b.s", " JOIN sd a ON a.k = i JOIN sd b ON b.k = j"),
        "cov_two_way": plain(EMBEDDINGS, two_way(8, 8), select=f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('c')}, axis FROM (SELECT *, 'expiry' AS axis FROM ce UNION ALL SELECT *, 'tenor' AS axis FROM ct)"),
        "cov_separable_target": plain(PANEL, two_way(7, 4), select=f"SELECT CAST(ce.i * 4 + ct.i AS INTEGER) AS i, CAST(ce.j * 4 + ct.j AS INTEGER) AS j, {r('ce.c * ct.c', 'c')} FROM ce, ct"),
        "cov_separable_shrink": plain(
            PANEL, two_way(7, 4), "cov AS (SELECT a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM cen a JOIN cen b USING (t) GROUP BY 1, 2)", "target AS (SELECT ce.i * 4 + ct.i AS i, ce.j * 4 + ct.j AS j, ce.c * ct.c AS d FROM ce, ct)",
            "scale AS (SELECT (SELECT sum(c) FROM cov WHERE i = j) / (SELECT sum(d) FROM target WHERE i = j) AS k)", select=f"SELECT i, j, {r('0.7 * c + 0.3 * k * d', 'c')} FROM cov JOIN target USING (i, j), scale WHERE i <= j"),
        "cov_trace": plain(EMBEDDINGS, COV, select=f"SELECT {r('sum(c)', 'trace')} FROM cov WHERE i = j"),
        "cov_alpha_held": covariance((PANEL, COV), "CASE WHEN i = j THEN c ELSE 0 END"),
        "cov_norms": plain(PANEL, COV, select=f"SELECT {r('sqrt(sum(c * c))', 'frobenius', 5)}, {r('max(abs(c))', 'largest', 5)}, {r('avg(CASE WHEN i = j THEN c END)', 'diagonal', 5)} FROM cov"),
        "cov_factor_diag": recursive(
            PANEL, COV, "g0 AS (SELECT 0 AS g, i, j, c FROM cov)", jacobi("eig", "g0", 28), "common AS (SELECT a.range AS i, b.range AS j, sum(greatest(lam, 0) * vec[a.range + 1] * vec[b.range + 1]) AS h FROM eig, range(28) a, range(28) b WHERE rk <= 3 GROUP BY 1, 2)",
            select=f"SELECT i, j, {r('0.5 * c + 0.5 * CASE WHEN i = j THEN h + greatest(c - h, 1e-12) ELSE h END', 'c')} FROM cov JOIN common USING (i, j) WHERE i <= j"),
        "cov_psd_repair": recursive(
            PANEL, COV, "g0 AS (SELECT 0 AS g, i, j, CASE WHEN i = j THEN c ELSE 3 * c END AS c FROM cov)", jacobi("eig", "g0", 28),
            select=f"SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, {r('sum(greatest(lam, 1e-12) * vec[a.range + 1] * vec[b.range + 1])', 'c', 5)} FROM eig, range(28) a, range(28) b WHERE a.range <= b.range GROUP BY 1, 2"),
        "cov_ledoit_wolf": shrunk("ledoit_wolf"),
        "cov_oas": shrunk("oas"),
        "folds": plain(moves(), select='SELECT w AS "window", CAST(f AS INTEGER) AS fold, CAST(s - w AS BIGINT) AS train_from, CAST(s AS BIGINT) AS train_to, CAST(s AS BIGINT) AS test_from, CAST(least(s + 10, n) AS BIGINT) AS test_to FROM (SELECT w, range AS f, w + 10 * range AS s FROM (SELECT unnest([20, 40, 100]) AS w), range(1000)), (SELECT count(*) AS n FROM whole) WHERE s < n'),
        "folds_expanding": plain(moves(), select='SELECT 40 AS "window", CAST(f AS INTEGER) AS fold, CAST(greatest(s - 40, 0) AS BIGINT) AS train_from, CAST(s AS BIGINT) AS train_to, CAST(s AS BIGINT) AS test_from, CAST(least(s + 10, n) AS BIGINT) AS test_to FROM (SELECT range AS f, 15 + 10 * range AS s FROM range(1000)), (SELECT count(*) AS n FROM whole) WHERE s < n'),
        "refits": plain(moves(), select="SELECT CAST(range AS INTEGER) AS fold, CAST(10 * range AS BIGINT) AS train_from, CAST(40 + 10 * range AS BIGINT) AS train_to FROM range(1000) WHERE 40 + 10 * range <= (SELECT count(*) FROM whole)"),
        "folds_train": plain(moves(), select='SELECT 40 AS "window", CAST(f.range AS INTEGER) AS fold, t FROM whole, range(1000) f WHERE 40 + 10 * f.range < (SELECT count(*) FROM whole) AND t >= 10 * f.range AND t < 40 + 10 * f.range'),
        "folds_test": plain(moves(), select='SELECT 40 AS "window", CAST(f.range AS INTEGER) AS fold, t FROM whole, range(1000) f WHERE 40 + 10 * f.range < (SELECT count(*) FROM whole) AND t >= 40 + 10 * f.range AND t < 55 + 10 * f.range'),
        "pca_eigenvalues": recursive(PANEL, COV, "g0 AS (SELECT 0 AS g, i, j, c FROM cov)", jacobi("eig", "g0", 28), select=f"SELECT CAST(rk AS INTEGER) AS rank, {r('lam', 'eigenvalue', 5)} FROM eig"),
        "separable_eigs": recursive(EMBEDDINGS, two_way(8, 8), "g1 AS (SELECT 0 AS g, i, j, c FROM ce UNION ALL SELECT 1, i, j, c FROM ct)", jacobi("eig", "g1", 8), select=f"SELECT CASE g WHEN 0 THEN 'expiry' ELSE 'tenor' END AS axis, CAST(rk AS INTEGER) AS rank, {r('lam', 'eigenvalue')} FROM eig"),
        "pca_projected_pnl": recursive(*pca(ALL_ROWS), select=f"SELECT t, date, {r('full_pnl', digits=4)}, {r('projected_pnl', digits=4)}, {r('full_pnl - projected_pnl', 'error', 4)} FROM pred WHERE k = 2"),
        "separable_projected_pnl": recursive(*TWO, select=f"SELECT t, date, {r('any_value(full_pnl)', 'full_pnl', 4)}, {r('any_value(base) + sum(s * y)', 'projected_pnl', 4)} FROM tscore JOIN tprice USING (a, b) JOIN tfull USING (t), tbase GROUP BY 1, 2"),
        "walk_forward_predictions": recursive(*WALK, select=f'SELECT model, "window", fold, t, date, {r("full_pnl", digits=4)}, {r("projected_pnl", digits=4)}, {r("error", digits=4)} FROM preds'),
        "pnl_metrics": recursive(*SUMMARY, select=f'SELECT model, "window", {FIGURES} FROM summary'),
        "leaderboard": recursive(*SAMPLE_WALK, select=f'SELECT model, "window", {FIGURES} FROM summary ORDER BY {BEST} LIMIT 20'),
        "best_by_window": recursive(*SAMPLE_WALK, select='SELECT model, "window", error_rmse, CAST(row_number() OVER (PARTITION BY "window" ORDER BY rmse, p95, model) AS INTEGER) AS place FROM summary QUALIFY place <= 5'),
        "window_perf": recursive(*SAMPLE_WALK, select=f'SELECT "window", {r("median(rmse)", "median_rmse", 4)}, {r("min(rmse)", "best_rmse", 4)}, {r("median(explained)", "median_explained", 4)}, {r("max(explained)", "best_explained", 4)} FROM summary GROUP BY 1'),
        "group_perf": recursive(*SAMPLE_WALK, select=f"SELECT family, transform, covariance, {r('min(rmse)', 'best_rmse', 4)}, {r('median(rmse)', 'median_rmse', 4)}, {r('max(explained)', 'best_explained', 4)} FROM summary JOIN spec USING (model) GROUP BY 1, 2, 3"),
        "best_model": recursive(*SAMPLE_WALK, select=f'SELECT model, "window", error_rmse, transform AS spec_transform, k AS spec_n_components FROM summary JOIN spec USING (model) ORDER BY {BEST} LIMIT 1'),
        **{f"walk_forward_{k}": recursive(*grid_walk(own), spec_values(own), select=f'SELECT model, "window", {FIGURES}, family, transform, covariance AS spec_covariance_method, k AS spec_n_components, re AS spec_r_expiry, rt AS spec_r_tenor, CAST(NULL AS VARCHAR) AS status FROM summary JOIN spec USING (model)') for k, own in KINDS.items()},
        "walk_forward_status": plain(moves(), select="SELECT 'Abs PCA sample k=1' AS model, 20 AS \"window\", (SELECT count(*) - 20 FROM whole) AS n_test_obs, CAST(NULL AS VARCHAR) AS status UNION ALL SELECT 'Abs PCA sample k=1', 500, NULL, 'failed_or_no_predictions'"),
        "contrib_pca": recursive(*pca(ALL_ROWS), select=f"SELECT t, date, 'PC' || rk AS component, {r('s * y', 'pnl', 4)} FROM score JOIN price USING (g, rk) JOIN fullp USING (g, t) WHERE rk <= 2"),
        "contrib_separable": recursive(*TWO, select=f"SELECT t, date, 'E' || a || 'xT' || b AS component, {r('s * y', 'pnl', 4)} FROM tscore JOIN tprice USING (a, b) JOIN tfull USING (t)"),
        "component_stats": recursive(*pca(ALL_ROWS), select=f"SELECT 'PC' || rk AS component, {r('avg(s * y)', 'mean_contribution', 4)}, {r('stddev_samp(s * y)', 'std_contribution', 4)}, {r('avg(abs(s * y))', 'avg_abs_contribution', 4)}, {r('max(abs(s * y))', 'max_abs_contribution', 4)} FROM score JOIN price USING (g, rk) WHERE rk <= 2 GROUP BY rk"),
        "top_components": recursive(*pca(ALL_ROWS, 8), "size AS (SELECT rk, avg(abs(s * y)) AS a FROM score JOIN price USING (g, rk) GROUP BY rk ORDER BY a DESC LIMIT 6)", select=f"SELECT t, date, {r('sum(s * y)', 'pnl', 4)} FROM score JOIN price USING (g, rk) JOIN size USING (rk) JOIN fullp USING (g, t) GROUP BY 1, 2"),
        "noise_ratio": recursive(*pca(ALL_ROWS), select=f"SELECT bucket, {LABEL_OF}, {r('var_samp(dvol - hat) / greatest(var_samp(dvol), 1e-16)', 'noise_ratio', 5)} FROM hat GROUP BY bucket"),
        "scatter_bounds": recursive(*pca(ALL_ROWS), select=f"SELECT {r('least(min(full_pnl), min(projected_pnl))', 'low', 4)}, {r('greatest(max(full_pnl), max(projected_pnl))', 'high', 4)} FROM pred WHERE k = 2"),
        "pca_projector": recursive(*pca(ALL_ROWS), select=f"SELECT a.bucket AS i, b.bucket AS j, {r('sum(a.w * b.w)', 'p', 5)} FROM load a JOIN load b USING (g, rk) WHERE rk <= 2 GROUP BY 1, 2"),
        "pca_projector_norm": recursive(*pca(ALL_ROWS), "entries AS (SELECT k, a.bucket AS i, b.bucket AS j, sum(a.w * b.w) AS p FROM load a JOIN load b USING (g, rk), ks WHERE rk <= k GROUP BY 1, 2, 3)", select=f"SELECT k, {r('sqrt(sum(p * p))', 'norm', 5)}, {r('sum(CASE WHEN i = j THEN p END)', 'trace', 5)} FROM entries GROUP BY 1"),
        "loadings_pca": recursive(*pca(ALL_ROWS), "turned AS (SELECT rk, bucket, w * sign(arg_max(w, abs(w)) OVER (PARTITION BY rk)) AS w FROM load WHERE rk <= 2)", select=f"SELECT 'PC' || rk AS component, bucket, {LABEL_OF}, {r('w', 'loading', 5)} FROM turned"),
        "loadings_weighted": recursive(
            *pca(WEIGHTED_ROWS), "turned AS (SELECT bucket, w * sign(arg_max(w, abs(w)) OVER ()) AS w FROM load WHERE rk = 1)", select=f"SELECT 'PC1' AS component, bucket, {LABEL_OF}, {r('turned.w / weight.w', 'loading', 5)} FROM turned JOIN weight USING (bucket)"),
        "loadings_two_way": recursive(
            *TWO, "te AS (SELECT rk, CAST(q.range AS INTEGER) AS e, vec[q.range + 1] AS v FROM ee, range(7) q WHERE rk = 1)", "tt AS (SELECT rk, CAST(q.range AS INTEGER) AS m, vec[q.range + 1] AS v FROM et, range(4) q)",
            "se1 AS (SELECT rk, e, v * sign(arg_max(v, abs(v)) OVER (PARTITION BY rk)) AS v FROM te)", "st1 AS (SELECT rk, m, v * sign(arg_max(v, abs(v)) OVER (PARTITION BY rk)) AS v FROM tt)",
            select=f"SELECT component, bucket, {LABEL_OF}, loading FROM (SELECT 'E' || a.rk || 'xT' || b.rk AS component, e * 4 + m AS bucket, {r('a.v * b.v', 'loading', 5)} FROM se1 a, st1 b)"),
        "best_report_metrics": recursive(*BEST_ROWS, select=f'SELECT model, "window", {METRICS} FROM (SELECT *, full_pnl - projected_pnl AS error FROM bpred) GROUP BY 1, 2'),
        "best_report_risk": recursive(*BEST_ROWS, select=f"SELECT bucket, {LABEL_OF}, {r('any_value(vega)', 'vega', 4)}, {r('stddev_samp(dvol - hat)', 'residual_vol', 4)}, {r('any_value(abs(vega)) * stddev_samp(dvol - hat)', 'residual_risk', 4)} FROM bhat JOIN book USING (bucket) GROUP BY bucket"),
        "residual_risk": recursive(*pca(ALL_ROWS), select=f"{RISK}, {r('var_samp(dvol - hat) / greatest(var_samp(dvol), 1e-16)', 'noise_ratio', 4)} FROM hat JOIN book USING (bucket) GROUP BY bucket, vega"),
        "residual_pca": recursive(
            *pca(ALL_ROWS), "rest AS (SELECT t, bucket, dvol - hat - avg(dvol - hat) OVER (PARTITION BY bucket) AS x FROM hat)", "rcov AS (SELECT 0 AS g, a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM rest a JOIN rest b USING (t) GROUP BY 2, 3)",
            jacobi("reig", "rcov", 28), select=f"SELECT CAST(rk AS INTEGER) AS rank, {r('lam', 'eigenvalue', 4)} FROM reig WHERE rk <= 5"),
        "latest_report_metrics": recursive(*pca(LAST_ROWS), select=f"SELECT {METRICS} FROM (SELECT *, full_pnl - projected_pnl AS error FROM pred WHERE k = 2)"),
        "latest_report_risk": recursive(*pca(LAST_ROWS), select=f"{RISK} FROM hat JOIN book USING (bucket) GROUP BY bucket, vega"),
        "stability_pca": recursive(
            moves(), "refits AS (SELECT range AS g, 10 * range AS low FROM range(100) WHERE 40 + 10 * range <= (SELECT count(*) FROM whole))", "train AS (SELECT g, t, date, bucket, x FROM refits JOIN moves ON t >= low AND t < low + 40)",
            "dev AS (SELECT g, t, bucket, x - avg(x) OVER (PARTITION BY g, bucket) AS x FROM train)", "fcov AS (SELECT a.g, a.bucket AS i, b.bucket AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM dev a JOIN dev b USING (g, t) GROUP BY 1, 2, 3)", jacobi("eig", "fcov", 28),
            "proj AS (SELECT g, a.range AS i, b.range AS j, sum(vec[a.range + 1] * vec[b.range + 1]) AS u FROM eig, range(28) a, range(28) b WHERE rk <= 2 GROUP BY 1, 2, 3)", "ends AS (SELECT g, max(date) AS end_date FROM train GROUP BY 1)",
            select=f"SELECT CAST(n.g AS INTEGER) AS fold, end_date, {r('sqrt(sum((n.u - o.u) * (n.u - o.u)))', 'distance', 5)} FROM proj n JOIN proj o ON o.g = n.g - 1 AND o.i = n.i AND o.j = n.j JOIN ends ON ends.g = n.g GROUP BY 1, 2"),
        "stability_separable": recursive(
            moves(), "refits AS (SELECT range AS g, 10 * range AS low FROM range(100) WHERE 40 + 10 * range <= (SELECT count(*) FROM whole))", "train AS (SELECT g, t, date, bucket, x FROM refits JOIN moves ON t >= low AND t < low + 40)",
            "dev AS (SELECT g, t, bucket // 4 AS e, bucket % 4 AS m, x - avg(x) OVER (PARTITION BY g, bucket) AS x FROM train)", "ke AS (SELECT a.g, a.e AS i, b.e AS j, sum(a.x * b.x) / 4 / 39 AS c FROM dev a JOIN dev b USING (g, t, m) GROUP BY 1, 2, 3)", "kt AS (SELECT a.g, a.m AS i, b.m AS j, sum(a.x * b.x) / 7 / 39 AS c FROM dev a JOIN dev b USING (g, t, e) GROUP BY 1, 2, 3)",
            jacobi("ee", "ke", 7), jacobi("et", "kt", 4), "ends AS (SELECT g, max(date) AS end_date FROM train GROUP BY 1)",
            "pe AS (SELECT g, a.range AS i, b.range AS j, sum(vec[a.range + 1] * vec[b.range + 1]) AS u FROM ee, range(7) a, range(7) b WHERE rk <= 2 GROUP BY 1, 2, 3)", "pt AS (SELECT g, a.range AS i, b.range AS j, sum(vec[a.range + 1] * vec[b.range + 1]) AS u FROM et, range(4) a, range(4) b WHERE rk <= 2 GROUP BY 1, 2, 3)",
            "de AS (SELECT n.g, sqrt(sum((n.u - o.u) * (n.u - o.u))) AS d FROM pe n JOIN pe o ON o.g = n.g - 1 AND o.i = n.i AND o.j = n.j GROUP BY 1)", "dt AS (SELECT n.g, sqrt(sum((n.u - o.u) * (n.u - o.u))) AS d FROM pt n JOIN pt o ON o.g = n.g - 1 AND o.i = n.i AND o.j = n.j GROUP BY 1)",
            select=f"SELECT CAST(g AS INTEGER) AS fold, end_date, {r('de.d', 'expiry_distance', 5)}, {r('dt.d', 'tenor_distance', 5)} FROM de JOIN dt USING (g) JOIN ends USING (g)"),
        "basis": plain(*BASIS, select=f"SELECT o, r, {r('w')}, {r('w * v', 'dealt')} FROM basis JOIN fine USING (o)"),
        "basis_rowsum": plain(*BASIS, select=f"SELECT o, {r('sum(w)', 'total')}, count(*) AS nonzero, {r('sum(w * v)', 'dealt')} FROM basis JOIN fine USING (o) GROUP BY 1"),
        "basis_nnz": plain(*BASIS, select=f"SELECT count(*) AS nonzero, {r('sum(abs(w * v))', 'moved')} FROM basis JOIN fine USING (o) WHERE w <> 0"),
        "bilinear": plain(*BASIS, select=f"SELECT r, {r('sum(w * v)', 'v')} FROM basis JOIN fine USING (o) GROUP BY 1"),
        "cls": recursive(*CLS, select=f"SELECT r, {r('v')} FROM cls"),
        "cls_per_expiry": recursive(*BASIS, *ONE_GROUP, constrained("cls", "bb0", "bv0", len(panels.REDUCED_EXPIRIES), f"CASE WHEN {{j}} // {MT} = {{c}} THEN 1 ELSE 0 END", f"SELECT k AS c, sum(w * v) AS val FROM fine JOIN he ON he.i = o // {NT} GROUP BY 1"), select=f"SELECT r, {r('v')} FROM cls"),
        "price_quantiles": f"SELECT CAST(l_linenumber AS VARCHAR) || 'Y' AS expiry, CAST(l_partkey % 4 + 1 AS VARCHAR) || 'Y' AS tenor, {r('quantile_cont(l_extendedprice, 0.5)', 'median')}, {r('quantile_cont(l_extendedprice, 0.95)', 'p95')} FROM lineitem GROUP BY 1, 2",
        "cls_tikhonov": recursive(*BASIS, SMOOTH, ONE_GROUP[1], constrained("cls", "bb0", "bv0", 1, "1", TOTAL), select=f"SELECT r, {r('v')} FROM cls"),
        "cls_residuals": recursive(*RESIDUALS, select=f"SELECT o, {r('v')}, {r('fitted')}, {r('residual')} FROM res"),
        "leverage": recursive(*BASIS, *INVERSE, select=f"SELECT o, {r('leverage')} FROM lev"),
        "loo": recursive(*RESIDUALS, *INVERSE, select=f"SELECT o, {r('residual')}, {r('leverage')}, {r('residual / greatest(1 - leverage, 1e-6)', 'loo')} FROM res JOIN lev USING (o)"),
        "singular_values": recursive(*BASIS, *SIGMA, select=f"SELECT CAST(rk AS INTEGER) AS rank, {r('sqrt(lam)', 'sigma')} FROM sv"),
        "ladder_summary": recursive(
            *BOOTSTRAP[: len(CLS)], RESIDUALS[-1], *BOOTSTRAP[len(CLS) :], *INVERSE, *SIGMA, "made AS (SELECT sum(a.g * b.g * m[a.i + 1][" + str(M) + " + b.i + 1]) AS captured FROM bv a, bv b, inv_run WHERE k = " + str(M) + ")",
            "one AS (SELECT count(*) AS original_buckets, sum(v) AS total_original, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual)) AS mae, 1 - sum(residual * residual) / (var_pop(v) * count(*)) AS r2, max(abs(residual)) AS top, sqrt(avg(power(residual / greatest(1 - leverage, 1e-6), 2))) AS loo_rmse, avg(leverage) AS lm, max(leverage) AS lx, sum(v * v) AS energy FROM res JOIN lev USING (o))",
            "two AS (SELECT count(*) AS reduced_buckets, sum(v) AS total_reduced FROM cls)", "cond AS (SELECT sqrt(max(lam) / min(lam)) AS condition FROM sv)",
            select=f"""SELECT original_buckets, reduced_buckets, {r('original_buckets / reduced_buckets', 'compression')}, {r('total_original')}, {r('total_reduced')}, {r('abs(total_original - total_reduced)', 'total_error')}, {r('rmse')}, {r('mae')}, {r('r2')}, {r('top', 'max_abs_residual')},
              (SELECT o FROM res ORDER BY abs(residual) DESC, o LIMIT 1) AS worst_bucket, (SELECT fe.y FROM res JOIN fe ON fe.i = o // {NT} ORDER BY abs(residual) DESC, o LIMIT 1) AS worst_expiry, (SELECT ft.y FROM res JOIN ft ON ft.i = o % {NT} ORDER BY abs(residual) DESC, o LIMIT 1) AS worst_tenor, {r('loo_rmse')}, {r('condition')}, {r('100 * sqrt(greatest(energy - captured, 0) / energy)', 'unrepresentable_pct')}, {r('lm', 'mean_leverage')}, {r('lx', 'max_leverage')}, {r('(SELECT avg(std) FROM bstd)', 'mean_bootstrap_std')}, {r('(SELECT max(std) FROM bstd)', 'max_bootstrap_std')} FROM one, two, cond, made"""),
        "bootstrap_std": recursive(*BOOTSTRAP, select=f"SELECT r, {r('std')} FROM bstd"),
        "block_bootstrap_std": recursive(*bootstrap(PATCHES), select=f"SELECT r, {r('std')} FROM bstd"),
        "reliability_rank": recursive(*BOOTSTRAP, select=f"SELECT r, {r('placed.v', 'v')}, {r('std')}, {r('cv')}, CAST(place AS INTEGER) AS place, CASE WHEN place <= 5 THEN 'best' ELSE 'worst' END AS side, {r('re.y', 'expiry')}, {r('rt.y', 'tenor')} FROM placed JOIN re ON re.i = r // {MT} JOIN rt ON rt.i = r % {MT} WHERE place <= 5 OR place > 19"),
        "coarse_matrix": recursive(*CLS, select="SELECT " + r("re.y", "expiry") + ", " + ", ".join(f'round(max(cls.v) FILTER (rt.y = {y}), 6) + 0.0 AS "{y}Y"' for y in panels.REDUCED_TENORS) + f" FROM cls JOIN re ON re.i = r // {MT} JOIN rt ON rt.i = r % {MT} GROUP BY 1"),
        "book_matrix": plain(BOOK, select="SELECT CAST(bucket // 4 + 1 AS VARCHAR) || 'Y' AS expiry, " + ", ".join(f'round(max(vega) FILTER (bucket % 4 = {i}), 6) + 0.0 AS "{i + 1}Y"' for i in range(4)) + " FROM book GROUP BY 1"),
        "book_vector": plain(BOOK, select=f"SELECT bucket AS pos, {r('vega')} FROM book"),
        "vega_formatted": plain(BOOK, select="SELECT bucket, format('{:,.2f}', vega) AS vega, format('{:.2e}', vega) AS power, format('{:.1f}%', 100 * abs(vega) / sum(abs(vega)) OVER ()) AS share FROM book"),
        "ladder_dashboard": recursive(*RESIDUALS, *INVERSE, "cells AS (SELECT o // 10 AS e, o % 10 AS m, v, residual, leverage, residual / greatest(1 - leverage, 1e-6) AS loo FROM res JOIN lev USING (o))", select="SELECT measure, y AS expiry, " + ", ".join(f'round(max(value) FILTER (m = {i}), 6) + 0.0 AS "{y}Y"' for i, y in enumerate(panels.LADDER_TENORS)) + " FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS measure, e, m, {k} AS value FROM cells" for k in ("v", "residual", "leverage", "loo")) + ") JOIN fe ON fe.i = e GROUP BY 1, 2"),
        "risk_matrices": recursive(*pca(ALL_ROWS), "shown AS (SELECT bucket, abs(vega) * stddev_samp(dvol - hat) AS residual_risk, var_samp(dvol - hat) / greatest(var_samp(dvol), 1e-16) AS noise_ratio FROM hat JOIN book USING (bucket) GROUP BY bucket, vega)", select="SELECT measure, CAST(bucket // 4 + 1 AS VARCHAR) || 'Y' AS expiry, " + ", ".join(f'round(max(value) FILTER (bucket % 4 = {i}), 4) + 0.0 AS "{i + 1}Y"' for i in range(4)) + " FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS measure, bucket, {k} AS value FROM shown" for k in ("residual_risk", "noise_ratio")) + ") GROUP BY 1, 2"),
        "csv_vega": plain(BOOK, select=f"SELECT {LABEL_OF}, {r('vega')} FROM book"),
        "csv_ladder": plain(*BASIS[:2], BASIS[7], select=f"SELECT o, CAST(fe.i AS INTEGER) AS e_idx, CAST(ft.i AS INTEGER) AS t_idx, {r('fe.y', 'e_years')}, {r('ft.y', 't_years')}, {r('v')} FROM fine JOIN fe ON fe.i = o // {NT} JOIN ft ON ft.i = o % {NT}"),
    }
    # What was written as files and read back is what was there.
    return found | {name: found[of] for name, of in {"csv_surface": "surface_long", "csv_full_pnl": "full_pnl", "csv_results": "pnl_metrics", "csv_predictions": "walk_forward_predictions"}.items()}
