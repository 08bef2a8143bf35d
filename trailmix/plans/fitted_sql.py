"""SQL statements that take the same training steps as the fitted models.

Parameters are a wide table: one row a key, b for the bias (or weight) and f1..fk for the factors. A recursive
common table expression moves all of it one step at a time; a step's gradients are grouped sums.
"""

from __future__ import annotations

from collections.abc import Sequence


def draw_sql(*keys) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(str(k) for k in keys)})), 1, 8))::BIGINT"


def normal_sql(key: str, dim: int, seed: int) -> str:
    """Standard normal value of (key, dim, seed), by Box-Muller from one digest."""
    digest = f"md5(concat_ws('|', {key}, {dim}, {seed}))"
    first, second = (f"((('0x' || substr({digest}, {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for at in (1, 9))
    return f"sqrt(-2.0::DOUBLE * ln({first})) * cos(2.0::DOUBLE * pi() * {second})"


def columns(k: int, form: str, join: str = ", ") -> str:
    """``form`` for each factor, with the factor's number for ``#``; starts with the joint if k is 0."""
    return join.join(form.replace("#", str(d)) for d in range(1, k + 1))


def initial_sql(keys: str, k: int, std: float, seed: int) -> str:
    factors = "".join(f", {std}::DOUBLE * {normal_sql('key', d, seed)} AS f{d}" for d in range(1, k + 1))
    return f"SELECT key, 0.0::DOUBLE AS b{factors} FROM ({keys})"


def damped_sql(name: str, ctes: str, keys: str, k: int, std: float, seed: int, steps: int, lr: float, reg: float,
               examples: str, grads: Sequence[tuple[str, str, str]]) -> str:
    """(key, b, f1..fk) after ``steps`` damped steps.

    ``examples`` selects a step's rows with what the gradients mention (``s.step`` is the step, ``st`` the
    parameters); each of ``grads`` is (key, gradient of the bias, gradient of factor #).
    """
    parts = " UNION ALL ".join(
        f"SELECT {key} AS key, count(*) AS n, sum({gb}) AS gb, {columns(k, f'sum({gf}) AS g#')} FROM e GROUP BY ALL" for key, gb, gf in grads)
    totals = parts if len({key for key, _, _ in grads}) == len(grads) == 2 else (
        f"SELECT key, sum(n) AS n, sum(gb) AS gb, {columns(k, 'sum(g#) AS g#')} FROM ({parts}) GROUP BY key")
    return f"""
WITH RECURSIVE {ctes}, {name}_st AS (
  SELECT 0 AS step, * FROM ({initial_sql(keys, k, std, seed)})
  UNION ALL
  SELECT step, key, b + rate * (gb - n * {reg}::DOUBLE * b) AS b, {columns(k, f'f# + rate * (g# - n * {reg}::DOUBLE * f#) AS f#')} FROM (
    WITH e AS MATERIALIZED ({examples}),
    t AS ({totals})
    SELECT st.step + 1 AS step, st.*EXCLUDE (step), coalesce(n, 0)::DOUBLE AS n, coalesce(gb, 0) AS gb, {columns(k, 'coalesce(g#, 0) AS g#')},
      CASE WHEN n IS NULL THEN 0 ELSE (1.0::DOUBLE - pow({1.0 - lr!r}::DOUBLE, n::DOUBLE)) / n::DOUBLE END AS rate
    FROM {name}_st st LEFT JOIN t ON st.key = t.key WHERE st.step < {steps}))
SELECT * EXCLUDE (step) FROM {name}_st WHERE step = {steps}"""


def scaled_sql(name: str, ctes: str, keys: str, k: int, std: float, seed: int, steps: int, lr: float, reg: float,
               least: float, examples: str, grads: Sequence[tuple[str, str, str]]) -> str:
    """(key, b, f1..fk) after ``steps`` steps of the mean gradient over the root of its accumulated squares.

    The key 'bias' starts without factors. Arguments as in ``damped_sql``.
    """
    names = ["b", *(f"f{d}" for d in range(1, k + 1))]
    parts = " UNION ALL ".join(
        f"SELECT {key} AS key, count(*) AS n, " + ", ".join(f"sum({(gb if v == 'b' else gf.replace('#', v[1:]))}) AS g_{v}" for v in names)
        + " FROM e GROUP BY ALL" for key, gb, gf in grads)
    means = ", ".join(f"CASE WHEN n IS NULL THEN 0 ELSE g_{v} / n::DOUBLE - {reg}::DOUBLE * {v} END AS g_{v}" for v in names)
    start = ", ".join(f"CASE WHEN key = 'bias' THEN 0 ELSE {v} END AS {v}" for v in names)
    move = ", ".join(f"{v} + {lr}::DOUBLE * g_{v} / (sqrt(a_{v} + g_{v} * g_{v}) + {least}::DOUBLE) AS {v}" for v in names)
    return f"""
WITH RECURSIVE {ctes}, {name}_st AS (
  SELECT 0 AS step, key, {start}, {", ".join(f"0.0::DOUBLE AS a_{v}" for v in names)} FROM ({initial_sql(keys, k, std, seed)})
  UNION ALL
  SELECT step, key, {move}, {", ".join(f"a_{v} + g_{v} * g_{v} AS a_{v}" for v in names)} FROM (
    WITH e AS MATERIALIZED ({examples}),
    t AS (SELECT key, sum(n) AS n, {", ".join(f"sum(g_{v}) AS g_{v}" for v in names)} FROM ({parts}) GROUP BY key)
    SELECT st.step + 1 AS step, st.* EXCLUDE (step), {means}
    FROM {name}_st st LEFT JOIN t ON st.key = t.key WHERE st.step < {steps}))
SELECT key, {", ".join(names)} FROM {name}_st WHERE step = {steps}"""


def click_sql(name: str, source: str, fields: Sequence[str], k: int, epochs: int, lr: float, reg: float, std: float,
              least: float, seed: int, strata: int) -> str:
    """A click model fitted to ``source`` (user_id, item_id, label and one key column for each of ``fields``)."""
    rows = f"""{name}_rows AS MATERIALIZED (
  SELECT *, 'bias' AS bias, (({draw_sql("'i'", 'item_id')} - {draw_sql("'u'", 'user_id')}) % {strata} + {strata}) % {strata} AS part
  FROM {source})"""
    every = ["bias", *fields]
    keys = " UNION ".join(f"SELECT DISTINCT {f} AS key FROM {name}_rows" for f in every)
    weights = " + ".join(f"x_{f}.b" for f in every)
    total = [" + ".join(f"x_{f}.f{d}" for f in fields) for d in range(1, k + 1)]
    pair = " + ".join(f"({t}) * ({t}) - (" + " + ".join(f"x_{f}.f{d} * x_{f}.f{d}" for f in fields) + ")" for d, t in enumerate(total, 1))
    shown = [f"r.{f}" for f in every] + [f"{t} AS t{d}" for d, t in enumerate(total, 1)] + [
        f"x_{f}.f{d} AS {f}_{d}" for f in fields for d in range(1, k + 1)]
    logit = weights + (f" + 0.5::DOUBLE * ({pair})" if k else "")
    examples = f"""SELECT {", ".join(shown)}, label - 1.0::DOUBLE / (1.0::DOUBLE + exp(-({logit}))) AS err
      FROM {name}_rows r, {", ".join(f"{name}_st x_{f}" for f in every)}
      WHERE r.part = x_bias.step % {strata} AND {" AND ".join(f"x_{f}.key = r.{f}" for f in every)}"""
    grads = [("bias", "err", "0.0::DOUBLE"), *((f, "err", f"err * (t# - {f}_#)") for f in fields)]
    return scaled_sql(name, rows, keys, k, std, seed, epochs * strata, lr, reg, least, examples, grads)


def mf_sql(k: int, epochs: int, lr: float, reg: float, std: float, seed: int, strata: int, name: str = "mf", source: str = "tr") -> str:
    pairs = f"""{name}_rows AS MATERIALIZED (
  SELECT 'u:' || user_id AS u, 'i:' || item_id AS i, rating::DOUBLE AS y,
    (({draw_sql("'i'", 'item_id')} - {draw_sql("'u'", 'user_id')}) % {strata} + {strata}) % {strata} AS part
  FROM {source}), {name}_mean AS MATERIALIZED (SELECT avg(rating::DOUBLE) AS mu FROM {source})"""
    keys = f"SELECT DISTINCT u AS key FROM {name}_rows UNION ALL SELECT DISTINCT i FROM {name}_rows"
    examples = f"""SELECT r.u, r.i, y - (mu + p.b + q.b + ({columns(k, 'p.f# * q.f#', ' + ')})) AS err,
      {columns(k, 'p.f# AS p#')}, {columns(k, 'q.f# AS q#')}
      FROM {name}_rows r, {name}_mean, {name}_st p, {name}_st q WHERE p.key = r.u AND q.key = r.i AND r.part = p.step % {strata}"""
    return damped_sql(name, pairs, keys, k, std, seed, epochs * strata, lr, reg, examples,
                      [("u", "err", "err * q#"), ("i", "err", "err * p#")])


def bpr_sql(k: int, iters: int, lr: float, reg: float, seed: int) -> str:
    rows = """bpr_rows AS MATERIALIZED (SELECT user_id, item_id, unnest(range(count(*))) AS copy FROM tr GROUP BY 1, 2),
bpr_items AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM tr)),
bpr_total AS MATERIALIZED (SELECT count(*) AS total FROM bpr_items),
bpr_known AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM tr)"""
    keys = "SELECT 'u:' || user_id AS key FROM tr GROUP BY 1 UNION ALL SELECT 'i:' || item_id FROM tr GROUP BY 1"
    examples = f"""
      WITH now AS (SELECT max(step) AS step FROM bpr_st),
      d AS (SELECT r.user_id, r.item_id, x.item_id AS negative
        FROM (SELECT r.*, {draw_sql('user_id', 'item_id', 'copy', 'step', seed)} % total AS idx FROM bpr_rows r, now, bpr_total) r
        JOIN bpr_items x ON x.idx = r.idx
        ANTI JOIN bpr_known w ON w.user_id = r.user_id AND w.item_id = x.item_id)
      SELECT 'u:' || d.user_id AS u, 'i:' || d.item_id AS i, 'i:' || d.negative AS j,
        1.0::DOUBLE / (1.0::DOUBLE + exp(p.b * 0 + a.b - c.b + ({columns(k, 'p.f# * (a.f# - c.f#)', ' + ')}))) AS z,
        {columns(k, 'p.f# AS p#')}, {columns(k, 'a.f# - c.f# AS d#')}
      FROM d, bpr_st p, bpr_st a, bpr_st c
      WHERE p.key = 'u:' || d.user_id AND a.key = 'i:' || d.item_id AND c.key = 'i:' || d.negative"""
    return damped_sql("bpr", rows, keys, k, 1.0 / k, seed, iters, lr, reg, examples,
                      [("u", "0.0::DOUBLE", "z * d#"), ("i", "z", "z * p#"), ("j", "-z", "-z * p#")])


def factor_scores_sql(fitted: str, k: int, constant: str = "0.0") -> str:
    """(user_id, item_id, score) of all pairs under a fitted table."""
    return f"""
SELECT user_id, item_id, {constant} + p.b + q.b + ({columns(k, 'p.f# * q.f#', ' + ')}) AS score
FROM (SELECT DISTINCT user_id FROM tr) JOIN {fitted} p ON p.key = 'u:' || user_id,
  (SELECT DISTINCT item_id FROM tr) JOIN {fitted} q ON q.key = 'i:' || item_id"""
