"""SQL of the iterative fits: Newton steps in recursive queries over lists, one row per series and step."""

from __future__ import annotations

from meteorium.functions import numeric as num

from .polynomials import p_sql, poly


def ppf_sql(p: str) -> str:
    """Standard normal quantile of an expression inside (0, 1)."""
    def ratio(top, bottom, x):
        return f"{poly(top[::-1], x)} / {poly(bottom[::-1], x)}"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    center = f"{q} * {ratio(num.PPF_A, num.PPF_B, f'(0.180625::DOUBLE - {q} * {q})')}"
    tail = f"(CASE WHEN {r} <= 5 THEN {ratio(num.PPF_C, num.PPF_D, f'({r} - 1.6::DOUBLE)')} ELSE {ratio(num.PPF_E, num.PPF_F, f'({r} - 5)')} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {center} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def drought_sql(source: str, keys: list[str], value: str, base: str) -> str:
    """CTEs that end in ``dry``: every row of ``source`` with its index ``spei``, by a log-logistic fit per key on the baseline years (five or more) or all."""
    k = ", ".join(keys)
    each = "list_transform(range(1, len(u) + 1), lambda i: {})"
    return f"""bs AS (SELECT {k}, list({value}) FILTER ({value} IS NOT NULL) AS av, list({value}) FILTER ({value} IS NOT NULL AND {base}) AS bv FROM {source} GROUP BY {k}),
      us AS (SELECT {k}, CASE WHEN len(bv) >= 5 THEN bv ELSE av END AS w FROM bs),
      sh AS (SELECT {k}, list_min(w) - 1e-6 AS shift, list_transform(w, lambda v: ln(v - (list_min(w) - 1e-6))) AS u FROM us),
      st AS (SELECT *, pi() / (sqrt(3::DOUBLE) * list_aggregate(u, 'stddev_pop')) AS c FROM sh WHERE len(u) >= 2 AND list_aggregate(u, 'stddev_pop') > 0),
      nt AS (SELECT {k}, shift, u, c, c * list_aggregate(u, 'median') AS a, 0 AS step FROM st
        UNION ALL SELECT {k}, shift, u, c + t * dc, a + t * da, step + 1 FROM (SELECT *, CASE WHEN dc < -0.9 * c THEN -0.9 * c / dc ELSE 1 END AS t FROM (
          SELECT *, (h12 * g2 - h22 * g1) / (h11 * h22 - h12 * h12) AS dc, (h12 * g1 - h11 * g2) / (h11 * h22 - h12 * h12) AS da FROM (
            SELECT *, len(u) / c + list_sum({each.format("(1 - 2 * f[i]) * u[i]")}) AS g1, -list_sum({each.format("1 - 2 * f[i]")}) AS g2,
              -len(u) / (c * c) - list_sum({each.format("2 * f[i] * (1 - f[i]) * u[i] * u[i]")}) AS h11, list_sum({each.format("2 * f[i] * (1 - f[i]) * u[i]")}) AS h12,
              -list_sum({each.format("2 * f[i] * (1 - f[i])")}) AS h22
            FROM (SELECT *, list_transform(u, lambda v: 1 / (1 + exp(-least(greatest(c * v - a, -700), 700)))) AS f FROM nt WHERE step < 40)))))
      , pr AS (SELECT s.*, least(greatest(1 / (1 + pow(greatest(s.{value} - nt.shift, 1e-9) / exp(nt.a / nt.c), -nt.c)), 1e-6), 1 - 1e-6) AS p FROM {source} s JOIN nt USING ({k}) WHERE step = 40 AND s.{value} IS NOT NULL),
      dry AS (SELECT * EXCLUDE (p), least(greatest({ppf_sql('p')}, -3), 3) AS spei FROM pr)"""


def count_fit_sql(source: str, keys: list[str], min_years: int, min_nonzero: int, excluded: str = "false") -> str:
    """CTEs that end in ``fits``: per key of ``source`` (year, count) the NB2 regression's own verdict and its published numbers."""
    k = ", ".join(keys)
    each = "list_sum(list_transform(range(1, len(y) + 1), lambda i: {}))"
    small = "coalesce(list_sum(list_transform(ks, lambda v: {})), 0)"

    def loglik(a, b, al):
        eta, mu = f"({a} + {b} * t[i])", f"exp({a} + {b} * t[i])"
        return f"({small.format(f'ln(1 + {al} * v)')} - lfact + {each.format(f'y[i] * {eta} - (y[i] + 1 / {al}) * ln(1 + {al} * {mu})')})"
    mu, q = "exp(a + b * t[i])", "(1 + al * exp(a + b * t[i]))"
    d = "damp * greatest(abs({0}), 1e-8)"
    return f"""packed AS (SELECT {k}, list(year::DOUBLE ORDER BY year) AS x, list(count::DOUBLE ORDER BY year) AS y FROM {source} WHERE NOT ({excluded}) GROUP BY {k}),
      ready AS (SELECT {k}, list_transform(x, lambda v: v - x[1]) AS t, y, list_transform(flatten(list_transform(y, lambda v: range(0, v::BIGINT))), lambda v: v::DOUBLE) AS ks FROM packed
        WHERE len(x) >= {min_years} AND len(list_filter(y, lambda v: v > 0)) >= {min_nonzero}),
      lf AS (SELECT *, coalesce(list_sum(list_transform(ks, lambda v: ln(v + 1))), 0) AS lfact, ln(greatest(list_avg(y), 1e-8)) AS a0 FROM ready),
      tr AS (SELECT {k}, t, y, ks, lfact, a0 AS a, 0::DOUBLE AS b, 0::DOUBLE AS l, {loglik('a0', '0', '1::DOUBLE')} AS ll, 0::DOUBLE AS damp, 0 AS trial, 0 AS iter, 'go' AS state, 0 AS step FROM lf
        UNION ALL SELECT {k}, t, y, ks, lfact, CASE WHEN moved THEN na ELSE a END, CASE WHEN moved THEN nb ELSE b END, CASE WHEN moved THEN nl ELSE l END, CASE WHEN moved THEN nll ELSE ll END,
          CASE WHEN moved THEN 0 ELSE greatest(damp * 10, 1e-6) END, CASE WHEN moved THEN 0 ELSE trial + 1 END, CASE WHEN moved THEN iter + 1 ELSE iter END,
          CASE WHEN near THEN 'ok' WHEN moved AND nl < -11 THEN 'bad' WHEN NOT moved AND trial >= 39 THEN 'bad' WHEN moved AND iter >= 199 THEN 'bad' ELSE 'go' END, step + 1
        FROM (SELECT *, NOT near AND pd AND isfinite(nll) AND nll >= ll - 1e-12 * abs(ll) AS moved FROM (SELECT *, {loglik('na', 'nb', 'exp(nl)')} AS nll FROM (
          SELECT *, a + least(greatest(s1, -2), 2) AS na, b + least(greatest(s2, -2), 2) AS nb, l + least(greatest(s3, -2), 2) AS nl FROM (
          SELECT *, i11 > 0 AND i11 * i22 - i12 * i12 > 0 AND det > 0 AS pd, (c11 * g1 + c12 * g2 + c13 * g3) / det AS s1, (c12 * g1 + c22 * g2 + c23 * g3) / det AS s2, (c13 * g1 + c23 * g2 + c33 * g3) / det AS s3 FROM (
          SELECT *, i11 * c11 + i12 * c12 + i13 * c13 AS det FROM (
          SELECT *, i22 * i33 - i23 * i23 AS c11, i13 * i23 - i12 * i33 AS c12, i12 * i23 - i13 * i22 AS c13, i11 * i33 - i13 * i13 AS c22, i12 * i13 - i11 * i23 AS c23, i11 * i22 - i12 * i12 AS c33 FROM (
          SELECT * EXCLUDE (j11, j22, j33), j11 + {d.format('j11')} AS i11, j22 + {d.format('j22')} AS i22, j33 + {d.format('j33')} AS i33 FROM (
          SELECT *, greatest(abs(g1), abs(g2) / greatest(1, list_max(t)), abs(g3)) < 1e-7 * greatest(1, abs(ll)) AS near, -h11 AS j11, -h12 AS i12, -h22 AS j22, -h13 * al AS i13, -h23 * al AS i23,
            -haa * al * al - al * ga AS j33 FROM (
          SELECT *, ga * al AS g3 FROM (
          SELECT *, {each.format(f'(y[i] - {mu}) / {q}')} AS g1, {each.format(f'(y[i] - {mu}) / {q} * t[i]')} AS g2, {small.format('v / (1 + al * v)')} + {each.format(f'ln({q}) / (al * al) - (y[i] + 1 / al) * {mu} / {q}')} AS ga,
            {each.format(f'-{mu} * (1 + al * y[i]) / ({q} * {q})')} AS h11, {each.format(f'-{mu} * (1 + al * y[i]) / ({q} * {q}) * t[i]')} AS h12,
            {each.format(f'-{mu} * (1 + al * y[i]) / ({q} * {q}) * t[i] * t[i]')} AS h22, {each.format(f'-(y[i] - {mu}) * {mu} / ({q} * {q})')} AS h13,
            {each.format(f'-(y[i] - {mu}) * {mu} / ({q} * {q}) * t[i]')} AS h23,
            -{small.format('(v / (1 + al * v)) * (v / (1 + al * v))')} + {each.format(f'-2 * ln({q}) / (al * al * al) + 2 * {mu} / (al * al * {q}) + (y[i] + 1 / al) * ({mu} / {q}) * ({mu} / {q})')} AS haa
          FROM (SELECT *, exp(l) AS al FROM tr WHERE state = 'go')))))))))))),
      done AS (SELECT *, exp(l) AS al FROM tr WHERE state <> 'go'),
      hs AS (SELECT *, {each.format(f'{mu} * (1 + al * y[i]) / ({q} * {q})')} AS m11, {each.format(f'{mu} * (1 + al * y[i]) / ({q} * {q}) * t[i]')} AS m12,
        {each.format(f'{mu} * (1 + al * y[i]) / ({q} * {q}) * t[i] * t[i]')} AS m22, {each.format(f'(y[i] - {mu}) * {mu} / ({q} * {q})')} AS m13, {each.format(f'(y[i] - {mu}) * {mu} / ({q} * {q}) * t[i]')} AS m23,
        {small.format('(v / (1 + al * v)) * (v / (1 + al * v))')} - {each.format(f'-2 * ln({q}) / (al * al * al) + 2 * {mu} / (al * al * {q}) + (y[i] + 1 / al) * ({mu} / {q}) * ({mu} / {q})')} AS m33 FROM done),
      cv AS (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS dm FROM hs),
      ok AS (SELECT *, state = 'ok' AND m11 > 0 AND m11 * m22 - m12 * m12 > 0 AND dm > 0 AS good, (m11 * m33 - m13 * m13) / dm AS v11, (m22 * m33 - m23 * m23) / dm AS v00, (m13 * m23 - m12 * m33) / dm AS v01,
        list_aggregate(t, 'median') AS tm FROM cv),
      fits AS (SELECT {k}, good AS fit_ok, a, b, v00, v01, v11, CASE WHEN good THEN round_even(least(greatest((exp(b) - 1) * 100, -50), 50) * 100, 0) / 100 END AS rate,
        CASE WHEN good THEN round_even(exp(a + b * tm) * (exp(b * 10) - 1) * 10, 0) / 10 END AS per_decade,
        CASE WHEN good THEN round_even(least(greatest({p_sql('(b / sqrt(v11))')}, 0.0001), 0.9999) * 1000, 0) / 1000 END AS p_value,
        CASE WHEN good THEN round_even(al * 1000, 0) / 1000 END AS alpha, CASE WHEN good THEN round_even((6 - 2 * ll) * 10, 0) / 10 END AS aic FROM ok)"""
