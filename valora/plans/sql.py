"""SQL text helpers for the DuckDB oracle queries.

The oracle restates each operator's semantics in plain SQL over the same
parquet tables; nothing here calls the Spark code.
"""

from __future__ import annotations

from valora.spec import FeatureDef


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r4(expr: str, digits: int = 4) -> str:
    """Rounded double with -0.0 normalised to 0.0 (as ``round_doubles``).

    Rounds the shortest decimal form half-up, as Spark's ``round`` does for
    doubles (DuckDB's double ``round`` works on the binary value, which
    differs on ties such as 39092.92625).
    """
    r = (f"CAST(round(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 17)), {digits}) "
         f"AS DOUBLE)")
    return f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"


def feature_sql(fd: FeatureDef, ins: list[str]) -> str:
    d = [f"CAST({x} AS DOUBLE)" for x in ins]
    k = fd.kind
    if k == "sum":
        return "(" + " + ".join(d) + ")"
    if k == "sum_nullzero":
        return "(" + " + ".join(f"coalesce({x}, 0.0)" for x in d) + ")"
    if k == "weighted_sum":
        return "(" + " + ".join(x if w == 1.0 else f"({float(w)!r} * {x})"
                                for w, x in zip(fd.weights, d, strict=True)) + ")"
    if k == "ratio_p1":
        return f"(CASE WHEN ({d[1]} + 1.0) = 0 THEN NULL ELSE {d[0]} / ({d[1]} + 1.0) END)"
    if k == "gt0_flag":
        return f"(CASE WHEN {d[0]} > 0 THEN 1 ELSE 0 END)"
    if k == "diff":
        return f"({d[0]} - {d[1]})"
    if k == "diff_clip0":
        return f"(CASE WHEN ({d[0]} - {d[1]}) < 0 THEN 0.0 ELSE ({d[0]} - {d[1]}) END)"
    if k == "ne_flag":
        return f"(CASE WHEN {d[0]} = {d[1]} THEN 0 ELSE 1 END)"
    if k == "eq_flag":
        return f"(CASE WHEN {d[0]} = {d[1]} THEN 1 ELSE 0 END)"
    if k == "product":
        return f"({d[0]} * {d[1]})"
    raise ValueError(k)


def features_sql(columns: list[str], features, alias: str = "") -> dict[str, str]:
    """SQL expression per derivable feature, earlier features inlined."""
    pre = f"{alias}." if alias else ""
    present = set(columns)
    out: dict[str, str] = {}
    for fd in features:
        if not all(n in present or n in out for n in (*fd.needed, *fd.inputs)):
            continue
        ins = [out[n] if n in out else pre + q(n) for n in fd.inputs]
        out[fd.name] = feature_sql(fd, ins)
    return out


def mode_sql(table: str, col: str) -> str:
    """Most frequent non-null value, ties to the smallest."""
    return (f"(SELECT {q(col)} FROM {table} WHERE {q(col)} IS NOT NULL GROUP BY {q(col)} "
            f"ORDER BY count(*) DESC, {q(col)} ASC LIMIT 1)")


def linear_fit_sql(rows: str, names: list[str], l1: float, l2: str, sweeps: int = 3000, exact: bool = True) -> str:
    """CTEs that fit ``1/(2n) |y - Xw - b|^2 + l1 |w|_1 + l2/2 |w|^2`` to the
    columns ``names`` and ``y`` of ``rows``: ``sol`` holds ``w`` as a list, and
    ``r``, the mean of each centred column times the residual.

    Without ``l1`` the normal equations are eliminated; with it, coordinates are
    descended one after another, and if ``exact`` the equations of the columns
    that are left in give the last digits (they have no unique solution where
    such columns are collinear and ``l2`` is 0).  The query needs WITH RECURSIVE.
    """
    k = len(names)
    values = ", ".join(f"CAST({q(n)} AS DOUBLE)" for n in names)
    ctes = f"""
xs AS (SELECT row_number() OVER () AS id, [{values}, y] AS v FROM {rows}),
cells AS (SELECT id, unnest(v) AS v, generate_subscripts(v, 1) AS j FROM xs),
centred AS (SELECT id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM cells),
gram AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / (SELECT count(*) FROM xs) AS g
         FROM centred a JOIN centred b ON a.id = b.id GROUP BY a.j, b.j),
gl AS (SELECT i, list(g ORDER BY j) AS line FROM gram GROUP BY i),
gm AS (SELECT list(line ORDER BY i) AS g, (SELECT count(*) FROM xs) AS n FROM gl WHERE i <= {k}),
lam AS (SELECT CAST({l2} AS DOUBLE) AS l2 FROM gm)"""
    if l1:
        ctes += f""",
cd AS (
  SELECT 0 AS step, list_transform(range({k}), lambda x: 0.0::DOUBLE) AS w,
         list_transform(g, lambda line: line[{k + 1}]) AS r FROM gm
  UNION ALL
  SELECT step + 1, list_transform(w, lambda v, i: CASE WHEN i = j THEN new ELSE v END),
         list_transform(r, lambda v, i: v - line[i] * (new - old))
  FROM (SELECT *, CASE WHEN abs(z) <= {l1!r} THEN 0.0 ELSE sign(z) * (abs(z) - {l1!r}) / (line[j] + l2) END AS new
        FROM (SELECT *, w[j] AS old, r[j] + line[j] * w[j] AS z
              FROM (SELECT cd.step, cd.w, cd.r, cd.step % {k} + 1 AS j, gm.g[cd.step % {k} + 1] AS line, lam.l2
                    FROM cd, gm, lam WHERE cd.step < {k * sweeps})))),
act AS (SELECT list_transform(w, lambda v: sign(v)) AS s FROM cd WHERE step = {k * sweeps})"""
    else:
        ctes += f""",
act AS (SELECT list_transform(range({k}), lambda x: 1) AS s)"""
    if not exact:
        return ctes + f""",
sol AS (SELECT w, r FROM cd WHERE step = {k * sweeps})"""
    on = "s[i] <> 0 AND s[j] <> 0" if l1 else "true"
    ctes += f""",
gj AS (
  SELECT 1 AS k, list_transform(g, lambda line, i: list_transform(line, lambda v, j:
           CASE WHEN j = {k + 1} THEN CASE WHEN s[i] <> 0 THEN v - {float(l1)!r} * {'s[i]' if l1 else '0'} ELSE 0.0 END
                WHEN {on} THEN v + CASE WHEN i = j THEN l2 ELSE 0.0 END
                WHEN i = j THEN 1.0 ELSE 0.0 END)) AS m FROM gm, act, lam
  UNION ALL
  SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda v: v / line[k])
           ELSE list_transform(line, lambda v, j: v - line[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {k}),
sol AS (
  SELECT w, list_transform(g, lambda line: line[{k + 1}] - list_sum(list_transform(w, lambda v, j: v * line[j]))) AS r
  FROM (SELECT list_transform(m, lambda line: line[{k + 1}]) AS w FROM gj WHERE k = {k + 1}), gm)"""
    return ctes
