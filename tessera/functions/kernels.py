"""Covariance kernels as expression trees: each compiles to a Column over two points and to numpy for grouped solvers.

Parameters are kept as logarithms, so that any real vector is valid. Points are array columns; ``dim`` picks one
coordinate, None uses all (Euclidean distance).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, squared_distance


@dataclass
class Kernel:
    params: list[float] = field(default_factory=list)  # logarithms
    dim: int | None = None

    name = "kernel"

    def __add__(self, other: Kernel) -> Kernel:
        return Sum(left=self, right=other)

    def __mul__(self, other: Kernel) -> Kernel:
        return Product(left=self, right=other)

    @property
    def values(self) -> list[float]:
        return [math.exp(p) for p in self.params]

    def get(self) -> list[float]:
        return list(self.params)

    def set(self, params) -> None:
        self.params = [float(p) for p in params]

    def copy(self) -> Kernel:
        return type(self)(params=self.get(), dim=self.dim)

    def components(self) -> list[Kernel]:
        """The additive terms of the tree."""
        return [self]

    def _points(self, x: np.ndarray) -> np.ndarray:
        return x if self.dim is None else x[:, self.dim : self.dim + 1]

    def _squared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self._points(x), self._points(y)
        return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)

    def _column_squared(self, x: Column, y: Column) -> Column:
        if self.dim is None:
            return squared_distance(x, y)
        return (x[self.dim] - y[self.dim]) * (x[self.dim] - y[self.dim])

    def __str__(self) -> str:
        return self.name if self.dim is None else f"{self.name}{self.dim}"


def _make(cls, dim=None, **values) -> Kernel:
    return cls(params=[math.log(v) for v in values.values()], dim=dim)


class SquaredExponential(Kernel):
    name = "SE"

    @classmethod
    def of(cls, variance: float = 1.0, length: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, variance=variance, length=length)

    def matrix(self, x, y):
        v, ell = self.values
        return v * np.exp(-self._squared(x, y) / (2 * ell**2))

    def column(self, x, y):
        v, ell = self.values
        return v * F.exp(-self._column_squared(x, y) / (2 * ell**2))


class Periodic(Kernel):
    name = "PER"

    @classmethod
    def of(cls, variance: float = 1.0, length: float = 1.0, period: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, variance=variance, length=length, period=period)

    def matrix(self, x, y):
        v, ell, p = self.values
        a, b = self._points(x), self._points(y)
        s = (np.sin(np.pi * (a[:, None] - b[None]) / p) ** 2).sum(2)
        return v * np.exp(-2 * s / ell**2)

    def column(self, x, y):
        v, ell, p = self.values
        wave = lambda d: F.sin(math.pi * d / p) * F.sin(math.pi * d / p)
        if self.dim is not None:
            s = wave(x[self.dim] - y[self.dim])
        else:
            s = F.aggregate(F.zip_with(x, y, lambda a, b: wave(a - b)), F.lit(0.0), lambda t, u: t + u)
        return v * F.exp(-2 * s / ell**2)


class Linear(Kernel):
    """bias + variance (x - centre)(y - centre); the centre is not a parameter of the search."""

    name = "LIN"

    @classmethod
    def of(cls, bias: float = 1.0, variance: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, bias=bias, variance=variance)

    def matrix(self, x, y):
        b, v = self.values
        return b + v * self._points(x) @ self._points(y).T

    def column(self, x, y):
        b, v = self.values
        return b + v * (dot(x, y) if self.dim is None else x[self.dim] * y[self.dim])


class RationalQuadratic(Kernel):
    name = "RQ"

    @classmethod
    def of(cls, variance: float = 1.0, length: float = 1.0, alpha: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, variance=variance, length=length, alpha=alpha)

    def matrix(self, x, y):
        v, ell, a = self.values
        return v * (1 + self._squared(x, y) / (2 * a * ell**2)) ** -a

    def column(self, x, y):
        v, ell, a = self.values
        return v * F.pow(1 + self._column_squared(x, y) / (2 * a * ell**2), F.lit(-a))


class Matern(Kernel):
    """Smoothness 5/2."""

    name = "MAT"

    @classmethod
    def of(cls, variance: float = 1.0, length: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, variance=variance, length=length)

    def matrix(self, x, y):
        v, ell = self.values
        r = np.sqrt(5 * self._squared(x, y)) / ell
        return v * (1 + r + r**2 / 3) * np.exp(-r)

    def column(self, x, y):
        v, ell = self.values
        r = F.sqrt(5 * self._column_squared(x, y)) / ell
        return v * (1 + r + r * r / 3) * F.exp(-r)


class WhiteNoise(Kernel):
    name = "WN"

    @classmethod
    def of(cls, variance: float = 1.0, dim: int | None = None) -> Kernel:
        return _make(cls, dim, variance=variance)

    def matrix(self, x, y):
        return self.values[0] * np.eye(len(x)) if x.shape == y.shape and np.allclose(x, y) else np.zeros((len(x), len(y)))

    def column(self, x, y):
        return F.when(x == y, self.values[0]).otherwise(0.0)


@dataclass
class _Pair(Kernel):
    left: Kernel = None
    right: Kernel = None

    sign = ""

    def get(self):
        return self.left.get() + self.right.get()

    def set(self, params):
        n = len(self.left.get())
        self.left.set(params[:n])
        self.right.set(params[n:])

    def copy(self):
        return type(self)(left=self.left.copy(), right=self.right.copy())

    def __str__(self):
        return f"({self.left} {self.sign} {self.right})"


class Sum(_Pair):
    sign = "+"

    def matrix(self, x, y):
        return self.left.matrix(x, y) + self.right.matrix(x, y)

    def column(self, x, y):
        return self.left.column(x, y) + self.right.column(x, y)

    def components(self):
        return self.left.components() + self.right.components()


class Product(_Pair):
    sign = "*"

    def matrix(self, x, y):
        return self.left.matrix(x, y) * self.right.matrix(x, y)

    def column(self, x, y):
        return self.left.column(x, y) * self.right.column(x, y)


BASES = {"SE": SquaredExponential, "PER": Periodic, "RQ": RationalQuadratic, "MAT": Matern, "LIN": Linear}
TERMS, POWER = 3, 2


def base(name: str, length: float = 1.0) -> Kernel:
    if name == "PER":
        return Periodic.of(length=length, period=2.0)
    return Linear.of() if name == "LIN" else BASES[name].of(length=length)


def from_code(code, length: float = 1.0) -> Kernel:
    """A sum of products: for each of the terms the power of each base kernel; an empty code is SE."""
    names, out = list(BASES), None
    for t in range(TERMS):
        term = None
        for b, name in enumerate(names):
            for _ in range(int(round(code[t * len(names) + b]))):
                k = base(name, length)
                term = k if term is None else term * k
        if term is not None:
            out = term if out is None else out + term
    return out if out is not None else base("SE", length)


def kernel_space(n: int, seed: int = 0) -> list[tuple[int, ...]]:
    """n different codes: the five base kernels, then simple, medium and complex ones in turn."""
    width = len(BASES)
    rng = np.random.default_rng(seed)
    out = [tuple(int(i == b) for i in range(TERMS * width)) for b in range(width)][:n]
    seen = set(out)
    for attempt in range(10 * n):
        if len(out) >= n:
            break
        level = attempt % 3
        terms = 1 if level == 0 else int(rng.integers(1, 3)) if level == 1 else int(rng.integers(2, TERMS + 1))
        per = 1 if level == 0 else int(rng.integers(1, 3)) if level == 1 else int(rng.integers(2, 4))
        code = np.zeros(TERMS * width, int)
        for t in range(terms):
            code[t * width + rng.choice(width, per, replace=False)] = rng.integers(1, POWER + 1, per)
        if tuple(code.tolist()) not in seen:
            seen.add(tuple(code.tolist()))
            out.append(tuple(code.tolist()))
    return out
