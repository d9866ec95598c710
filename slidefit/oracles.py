"""DuckDB SQL of windowed fits from their definitions.

A window is offsets with weights beta gamma^(j - delta), a model its basis functions of j, both as formulas that the database
evaluates. Gram matrices are sums of products of basis functions, normal equations are solved by elimination in SQL. Nothing
here comes from the engine's models, costs or estimator.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MONOMIALS = ("1", "j", "j * j", "j * j * j")


def forward(g: float) -> str:
    return f"({g!r}::DOUBLE / ({g!r}::DOUBLE - 1))"


def backward(g: float) -> str:
    return f"(({g!r}::DOUBLE - 1) / {g!r}::DOUBLE)"


@dataclass(frozen=True)
class Part:
    """One segment: offsets a .. b, weight formula, and what each state contributes at offset j."""

    a: int
    b: int
    gamma: str
    basis: tuple[str, ...]
    beta: float = 1.0
    delta: int = 0


def rounded(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def combined(factors, columns) -> str:
    """sum of factor * column without the zeros."""
    terms = [f"({f}) * ({c})" if f != 1 else f"({c})" for f, c in zip(factors, columns, strict=True) if f not in (0, "0")]
    return " + ".join(terms) or "0e0"


def at(basis: str, j: str = "0") -> str:
    """A basis function at another offset."""
    return re.sub(r"\bj\b", f"({j})", basis)


def window(parts: list[Part], tag: str = "") -> str:
    """CTEs o(j, g, p0, ..): the offsets of each segment; r: the weighted basis summed by offset; w: the Gram matrix."""
    n = len(parts[0].basis)
    rows = " UNION ALL ".join(f"SELECT j, {p.beta!r} * pow({p.gamma}, j - {p.delta}) AS g, {', '.join(f'({b})::DOUBLE AS p{i}' for i, b in enumerate(p.basis))} FROM (SELECT unnest(range({p.a}, {p.b} + 1)) AS j)" for p in parts)
    return f"""o{tag} AS ({rows}),
r{tag} AS (SELECT j, sum(g) AS g, {', '.join(f'sum(g * p{i}) AS r{i}' for i in range(n))} FROM o{tag} GROUP BY j),
w{tag} AS (SELECT {', '.join(f'sum(g * p{i} * p{k}) AS w{i}_{k}' for i in range(n) for k in range(n))} FROM o{tag})"""


def sums(parts: list[Part], signal: str) -> str:
    """CTEs sig, o, r, w and f(series_id, k, y, kappa, nu, xi0, ..): the windowed sums at every sample."""
    cols = ", ".join(f"coalesce(sum(b.y * r.r{i}), 0) AS xi{i}" for i in range(len(parts[0].basis)))
    return f"""sig AS ({signal}), {window(parts)},
f AS (SELECT a.series_id, a.k, any_value(a.y) AS y, coalesce(sum(b.y * b.y * r.g), 0) AS kappa, coalesce(sum(CASE WHEN b.y IS NOT NULL THEN r.g END), 0) AS nu, {cols}
      FROM sig a CROSS JOIN r LEFT JOIN sig b ON b.series_id = a.series_id AND b.k = a.k + r.j GROUP BY a.series_id, a.k)"""


def inverse(matrix: list[list[str]], tag: str, source: str = "w") -> str:
    """CTEs that end in i_tag(m0_0, ..): the inverse of a matrix of expressions over a one-row table, by elimination."""
    n = len(matrix)
    first = ", ".join(f"({matrix[i][k]})::DOUBLE AS a{i}_{k}" for i in range(n) for k in range(n)) + ", " + ", ".join(f"{float(i == k)!r}::DOUBLE AS a{i}_{n + k}" for i in range(n) for k in range(n))
    out, before = [f"e_{tag}_0 AS (SELECT {first} FROM {source})"], f"e_{tag}_0"
    for p in range(n):
        cells = [f"a{i}_{k} / a{p}_{p} AS a{i}_{k}" if i == p else f"a{i}_{k} - a{i}_{p} * a{p}_{k} / a{p}_{p} AS a{i}_{k}" for i in range(n) for k in range(2 * n)]
        out.append(f"e_{tag}_{p + 1} AS (SELECT {', '.join(cells)} FROM {before})")
        before = f"e_{tag}_{p + 1}"
    out.append(f"i_{tag} AS (SELECT {', '.join(f'a{i}_{n + k} AS m{i}_{k}' for i in range(n) for k in range(n))} FROM {before})")
    return ", ".join(out)


def solved(n: int, H=None, h=None, source: str = "f", tag: str = "s", x: str = "x", v: str | None = None, w: str = "w") -> str:  # noqa: N803
    """CTEs that end in tag: source with the states x0, .. = H v + h of the least cost (and v0, .. if named)."""
    H = [[float(i == k) for k in range(n)] for i in range(n)] if H is None else [[float(c) for c in r] for r in H]  # noqa: N806
    h = [0.0] * n if h is None else [float(c) for c in h]
    m = len(H[0])
    inner = [[combined([H[i][p] * H[k][q] for i in range(n) for k in range(n)], [f"w{i}_{k}" for i in range(n) for k in range(n)]) for q in range(m)] for p in range(m)]
    right = [combined([H[a][q] for a in range(n)], [f"xi{a} - ({combined(h, [f'w{a}_{b}' for b in range(n)])})" for a in range(n)]) for q in range(m)]
    values = [combined([f"m{p}_{q}" for q in range(m)], right) for p in range(m)]
    kept = v or f"_{tag}_v"
    states = [f"{combined(H[i], [f'{kept}{p}' for p in range(m)])} + {h[i]!r} AS {x}{i}" for i in range(n)]
    drop = "" if v else f" EXCLUDE ({', '.join(f'{kept}{p}' for p in range(m))})"
    return f"""{inverse(inner, tag, w)},
v_{tag} AS (SELECT {source}.*, {', '.join(f'{c} AS {kept}{p}' for p, c in enumerate(values))} FROM {source} CROSS JOIN {w} CROSS JOIN i_{tag}),
{tag} AS (SELECT *{drop}, {', '.join(states)} FROM v_{tag})"""


def cost(n: int, x: str = "x") -> str:
    """J of states, over their table joined with w."""
    square = combined([f"{x}{i} * {x}{k}" for i in range(n) for k in range(n)], [f"w{i}_{k}" for i in range(n) for k in range(n)])
    return f"(kappa + {square} - 2 * ({combined([f'{x}{i}' for i in range(n)], [f'xi{i}' for i in range(n)])}))"


def output(basis, x: str = "x", j: str = "0") -> str:
    """The models' value at an offset."""
    return "(" + combined([at(b, j) for b in basis], [f"{x}{i}" for i in range(len(basis))]) + ")"


def fit(parts: list[Part], signal: str, digits: int = 5, H=None, h=None, basis=None) -> str:  # noqa: N803
    """series_id, k, y_hat, J of a fit at every sample."""
    n = len(parts[0].basis)
    return f"WITH {sums(parts, signal)}, {solved(n, H, h)} SELECT series_id, k, {rounded(output(basis or parts[0].basis), digits, 'y_hat')}, {rounded(cost(n), digits, 'J')} FROM s CROSS JOIN w"
