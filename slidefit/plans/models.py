"""Autonomous linear state-space models: an output row C and a transition A, so that a state x gives C A^j x at offset j.

Models are small immutable values on the driver. Composed models keep their parts, and labels address their states.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
from numpy.polynomial import legendre

from . import check


def power(a: np.ndarray, j: int) -> np.ndarray:
    """Integer matrix powers, negative ones by the inverse."""
    return np.linalg.matrix_power(a, j) if j >= 0 else np.linalg.matrix_power(np.linalg.inv(a), -j)


def block_diagonal(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((sum(p.shape[0] for p in parts), sum(p.shape[1] for p in parts)))
    r = c = 0
    for p in parts:
        out[r : r + p.shape[0], c : c + p.shape[1]] = p
        r, c = r + p.shape[0], c + p.shape[1]
    return out


class ModelBase:
    """A (N x N) and C (N, or Q x N); update() sets both from a model's own parameters, so subclasses may be user-defined."""

    basis: str | None = None  # names a known structure for the steady-state Gram matrix

    def __init__(self, label: str = "n/a", force_MC: bool = False, alssms=(), lambdas=None):  # noqa: N803
        if not check.is_string(label):
            raise TypeError("label must be a string." + check.info_str_found_type(label))
        self.label, self.force_MC = label, bool(force_MC)
        self.alssms = list(alssms)
        if not all(isinstance(m, ModelBase) for m in self.alssms):
            raise TypeError("parts must be models")
        given = [1.0] * len(self.alssms) if lambdas is None else np.broadcast_to(np.asarray(lambdas, float), (len(self.alssms),)).tolist()
        self.lambdas = np.array(given)
        self._labels: dict[str, tuple[int, ...]] = {}
        self.update()

    def update(self) -> None:
        raise NotImplementedError

    def _set(self, a, c) -> None:
        a, c = np.asarray(a, float), np.asarray(c, float)
        if a.ndim != 2 or a.shape[0] != a.shape[1] or c.ndim > 2 or c.shape[-1] != len(a):
            raise ValueError(f"A must be square and C must have its width; found {a.shape} and {c.shape}")
        self.A, self.C = a, np.atleast_2d(c) if self.force_MC else c

    @property
    def N(self) -> int:  # noqa: N802
        return len(self.A)

    @property
    def Q(self) -> int:  # noqa: N802
        """Output width; 0 for a scalar output."""
        return 0 if self.C.ndim == 1 else self.C.shape[0]

    @property
    def is_MC(self) -> bool:  # noqa: N802
        return self.C.ndim == 2

    def rows(self) -> np.ndarray:
        """C as a matrix."""
        return np.atleast_2d(self.C)

    def output_row(self, j: int = 0) -> np.ndarray:
        return self.C @ power(self.A, j)

    def eval_output(self, xs, js=None) -> np.ndarray:
        """C A^j x for states in the last axis of xs: (..., [Q]) without js, else a leading axis over js."""
        xs = np.asarray(xs, float)
        one = lambda j: np.tensordot(xs, np.atleast_2d(self.output_row(j)).T, 1)
        squeeze = (lambda v: v[..., 0]) if self.C.ndim == 1 else (lambda v: v)
        return squeeze(one(0)) if js is None else np.stack([squeeze(one(int(j))) for j in js])

    def set_state_var_label(self, label: str, indices) -> None:
        self._labels[label] = tuple(int(i) for i in indices)

    def get_state_var_labels(self) -> dict[str, tuple[int, ...]]:
        """label.variable -> state indices; parts' labels are shifted to their place."""
        out = {f"{self.label}.{v}": idx for v, idx in {"x": tuple(range(self.N)), **self._own_labels(), **self._labels}.items()}
        at = 0
        for m in self.alssms if self._stacks() else []:
            out |= {f"{self.label}.{k}": tuple(i + at for i in idx) for k, idx in m.get_state_var_labels().items()}
            at += m.N
        return out

    def _own_labels(self) -> dict[str, tuple[int, ...]]:
        return {f"x{i}": (i,) for i in range(self.N)} if not self.alssms else {}

    def _stacks(self) -> bool:
        return True

    def get_state_var_indices(self, label: str) -> tuple[int, ...] | list:
        """Indices of a label, given in full or from any part on; an empty list if there is none."""
        found = self.get_state_var_labels()
        return found.get(label) or next((v for k, v in found.items() if k.endswith(f".{label}")), [])

    def get_alssm_output_dimension(self) -> int:
        return self.Q

    def dump_tree(self, depth: int = 0) -> str:
        return "\n".join([f"{'  ' * depth}└- {type(self).__name__}, A: {self.A.shape}, C: {self.C.shape}, label: {self.label}", *(m.dump_tree(depth + 1) for m in self.alssms)])

    def __str__(self) -> str:
        text = lambda v: np.array2string(v, separator=",", max_line_width=10**6).replace("\n", "").replace(" ", "").replace(".,", ",").replace(".]", "]")
        return f"{type(self).__name__}(A={text(self.A)}, C={text(self.C)}, label={self.label})"

    __repr__ = __str__


class Alssm(ModelBase):
    """Any transition and output."""

    def __init__(self, A, C, label: str = "n/a", force_MC: bool = False):
        self._given = (A, C)
        super().__init__(label, force_MC)

    def update(self) -> None:
        self._set(*self._given)


class _Polynomial(ModelBase):
    def __init__(self, poly_degree: int, C=None, label: str = "n/a", force_MC: bool = False):
        if not isinstance(poly_degree, int | np.integer) or poly_degree < 0:
            raise ValueError("poly_degree must be a non-negative whole number")
        self.poly_degree, self._c = int(poly_degree), C
        super().__init__(label, force_MC)

    def _first(self) -> np.ndarray:
        return np.eye(self.poly_degree + 1)[0] if self._c is None else np.asarray(self._c, float)


class AlssmPoly(_Polynomial):
    """Polynomial in the monomial basis: states are the coefficients of j^n; A[i, n] = binom(n, i)."""

    basis = "sum"

    def update(self) -> None:
        n = self.poly_degree + 1
        self._set([[comb(c, r) for c in range(n)] for r in range(n)], self._first())


class AlssmPolyJordan(_Polynomial):
    """Polynomial in the Newton basis binom(j, n): ones on and above the diagonal."""

    basis = "sum"

    def update(self) -> None:
        n = self.poly_degree + 1
        self._set(np.eye(n) + np.eye(n, k=1), self._first())


class AlssmPolyLegendre(ModelBase):
    """Polynomial in Legendre polynomials that are orthogonal over the segment [a_seg, b_seg]."""

    basis = "legendre"

    def __init__(self, poly_degree: int, a_seg: int = 0, b_seg: int | None = None, segment=None, label: str = "n/a", force_MC: bool = False):
        if segment is not None:
            a_seg, b_seg = segment.a, segment.b
        if b_seg is None or not np.isfinite([a_seg, b_seg]).all() or b_seg <= a_seg:
            raise ValueError("a Legendre model needs a finite segment with a_seg < b_seg")
        self.poly_degree, self.a_seg, self.b_seg = int(poly_degree), int(a_seg), int(b_seg)
        super().__init__(label, force_MC)

    @property
    def h(self) -> float:
        return 2.0 / (self.b_seg - self.a_seg)

    def update(self) -> None:
        n = self.poly_degree + 1
        # the coefficients of P_c(t + h), by interpolation at n Chebyshev points: exact for degree < n
        t = np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))
        shift = np.linalg.solve(legendre.legvander(t, n - 1), legendre.legvander(t + self.h, n - 1))
        self._set(np.triu(shift), legendre.legvander([-1.0 - self.h * self.a_seg], n - 1)[0])


class AlssmPolyMeixner(ModelBase):
    """Polynomial in Meixner polynomials, orthogonal under a one-sided exponential window.

    Backward ([a, inf)): A = I - triu(1, 1)/(g - 1), C = 1 before the shift to a. Forward ((-inf, b]): the inverse of A.
    """

    def __init__(self, poly_degree: int, segment, shift: int | None = None, label: str = "n/a", force_MC: bool = False):
        backward, forward = segment.b == np.inf, segment.a == -np.inf
        if backward == forward or backward != (segment.direction == "bw"):
            raise ValueError("a Meixner model needs a backward segment to infinity or a forward one from minus infinity")
        self.poly_degree, self.g, self.direction = int(poly_degree), float(segment.g), segment.direction
        self.shift = int(segment.a if backward else abs(segment.b)) if shift is None else int(shift)
        self.gamma = (self.g - 1) / self.g
        self.basis = "meixner" if backward else None
        super().__init__(label, force_MC)

    def update(self) -> None:
        n = self.poly_degree + 1
        step = np.eye(n) - np.triu(np.ones((n, n)), 1) / (self.g - 1)
        self._set(step if self.direction == "bw" else np.linalg.inv(step), np.ones(n) @ power(step, -self.shift))


class AlssmSin(ModelBase):
    """A rotation by omega, damped by rho each step."""

    def __init__(self, omega: float, rho: float = 1.0, C=None, label: str = "n/a", force_MC: bool = False):
        self.omega, self.rho, self._c = float(omega), float(rho), C
        super().__init__(label, force_MC)

    def update(self) -> None:
        z = self.rho * np.exp(1j * self.omega)
        self._set([[z.real, -z.imag], [z.imag, z.real]], [1.0, 0.0] if self._c is None else self._c)

    def _own_labels(self) -> dict[str, tuple[int, ...]]:
        return {"x0": (0,), "x1": (1,), "cos": (0,), "sin": (1,)}


class AlssmExp(ModelBase):
    """gamma^j."""

    def __init__(self, gamma: float, C=None, label: str = "n/a", force_MC: bool = False):
        self.gamma, self._c = float(gamma), C
        super().__init__(label, force_MC)

    def update(self) -> None:
        self._set([[self.gamma]], [1.0] if self._c is None else self._c)


class AlssmStacked(ModelBase):
    """Outputs side by side: block-diagonal A and C."""

    def __init__(self, alssms, lambdas=None, label: str = "n/a", force_MC: bool = False):
        super().__init__(label, force_MC, alssms, lambdas)

    def update(self) -> None:
        self._set(block_diagonal([m.A for m in self.alssms]), block_diagonal([s * m.rows() for s, m in zip(self.lambdas, self.alssms, strict=True)]))


class AlssmSum(ModelBase):
    """Outputs added: block-diagonal A, C joined."""

    def __init__(self, alssms, lambdas=None, label: str = "n/a", force_MC: bool = False):
        super().__init__(label, force_MC, alssms, lambdas)

    def update(self) -> None:
        if len({m.Q for m in self.alssms}) != 1:
            raise ValueError("summed models must have outputs of one width")
        self._set(block_diagonal([m.A for m in self.alssms]), np.concatenate([s * m.C for s, m in zip(self.lambdas, self.alssms, strict=True)], -1))


AlssmStackedSO = AlssmSum


class AlssmProd(ModelBase):
    """Outputs multiplied: Kronecker products of A and of C."""

    def __init__(self, alssms, lambdas=None, label: str = "n/a", force_MC: bool = False):
        super().__init__(label, force_MC, alssms, lambdas)

    def update(self) -> None:
        self._set(reduce(np.kron, [m.A for m in self.alssms]), reduce(np.kron, [s * m.C for s, m in zip(self.lambdas, self.alssms, strict=True)]))

    def _stacks(self) -> bool:
        return False

    def _own_labels(self) -> dict[str, tuple[int, ...]]:
        return {f"x{i}": (i,) for i in range(self.N)}


def transform_model(model: ModelBase, p) -> Alssm:
    """The same outputs from states P x: (P A P^-1, C P^-1)."""
    inverse = np.linalg.inv(p)
    return Alssm(p @ model.A @ inverse, model.C @ inverse, label=model.label)


def common_output_width(models) -> int:
    """The width all models share; raises if they differ."""
    widths = {m.Q for m in models}
    if len(widths) != 1:
        raise ValueError(f"outputs differ in width: {sorted(widths)}")
    return widths.pop()
