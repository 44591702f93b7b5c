"""Eigenvalues of integer matrices from their exact characteristic polynomial, and vectors by inverse iteration.

The polynomial comes from its remainders modulo primes (Hessenberg reduction, Chinese remainders). Its roots are real, so the
changes of sign among the coefficients of a shifted polynomial count the roots beyond the shift exactly, copies included.
"""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from functools import cache
from math import comb

import numpy as np


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes under ``limit`` whose product is above ``product``."""
    def is_prime(n: int) -> bool:
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    found, n, got = [], limit - 1 + limit % 2, 1
    while got <= product:
        if is_prime(n):
            found.append(n)
            got *= n
        n -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the polynomial of a positive semi-definite matrix is larger in size.

    The coefficient of x^(d-k) is the k-th elementary symmetric sum of roots that aren't negative, at most what equal roots give.
    """
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    return max([1] + [comb(d, k) * trace**k // d**k + 1 for k in range(1, d + 1)])


def polynomial_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """The characteristic polynomial modulo a prime under 2^31; coefficients from x^0 up, the last is 1."""
    a = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(len(matrix), -1)
    d = len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        at = k + int(below[0])
        if at != k:
            a[[k, at]] = a[[at, k]]
            a[:, [k, at]] = a[:, [at, k]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polys[k - 1, :-1]
        factors, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # entry above the diagonal times the run of entries below it
            factors[i] = int(a[i, k - 1]) * run % p
            run = run * int(a[i, i - 1]) % p if i else 0
        polys[k] = (now - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def chinese(primes: list[int], remainders: list[list[int]]) -> list[int]:
    """Whole numbers of least size with the given remainders; one list for each prime."""
    values, modulus = [0] * len(remainders[0]), 1
    for p, rest in zip(primes, remainders):
        inverse = pow(modulus % p, -1, p)
        values = [v + modulus * ((int(r) - v) * inverse % p) for v, r in zip(values, rest)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def _roots_above(poly: list[int], at: int) -> int:
    """How many roots are larger than ``at``: the changes of sign in the polynomial shifted by it."""
    c = list(poly)
    n = len(c) - 1
    if at:
        for i in range(n):
            for j in range(n - 1, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], x: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * x + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], count: int, bits: int = 192) -> list[tuple[int, int, int]]:
    """(numerator, power, copies) of the largest positive roots, falling: the root is numerator / 2^power, right to ``bits`` bits.

    ``poly``: whole coefficients from x^0 up with real roots, none negative. Roots that agree in all those bits come out as one
    with copies. Roots are listed until their copies reach ``count``.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    degree = len(poly) - 1
    if not degree:
        return []
    top = 1
    while _roots_above(poly, top):
        top *= 2

    @cache
    def finer(power: int) -> list[int]:
        return [c << power * (degree - i) for i, c in enumerate(poly)]

    # roots in (low, high] at scale 2^power, how many lie above each end; the largest part is taken first
    open_parts, found, got = [(0, top, degree, 0, 0)], [], 0
    while open_parts and got < count:
        low, high, above_low, above_high, power = open_parts.pop()
        here = above_low - above_high
        if not here:
            continue
        if high - low == 1:
            if low and low.bit_length() >= bits:
                found.append((2 * low + 1, power + 1, here))
                got += here
                continue
            step = 16 if here > 1 else max(16, bits + 8 - low.bit_length())
            low, high, power = low << step, high << step, power + step
        p = finer(power)
        if here == 1:
            # one root: the sign changes there and nowhere else between the ends
            before = _sign(p, low) or (1 if above_low % 2 == 0 else -1)
            while high - low > 1:
                middle = (low + high) // 2
                s = _sign(p, middle)
                if s == 0 or s != before:
                    high = middle
                else:
                    low = middle
            open_parts.append((low, high, above_low, above_high, power))
            continue
        middle = (low + high) // 2
        above = _roots_above(p, middle)
        open_parts.append((low, middle, above_low, above, power))
        open_parts.append((middle, high, above, above_high, power))
    return found


def null_vectors(matrix: list[list[int]], numerator: int, power: int, copies: int, digits: int = 90) -> list[list[Decimal]]:
    """Unit vectors, each orthogonal to the others, that the matrix less the root times one takes to nearly nothing.

    Inverse iteration by one factorisation in decimals of ``digits`` digits, from fixed starts, made orthogonal at each round.
    """
    d = len(matrix)
    with localcontext(Context(prec=digits, Emax=10**9, Emin=-(10**9))):
        root = Decimal(numerator) / (Decimal(2) ** power)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        size = max([abs(x) for x in a.flat] + [Decimal(1)])
        for i in range(d):
            a[i, i] -= root
        order = list(range(d))
        for k in range(d):
            at = max(range(k, d), key=lambda i: abs(a[i, k]))
            if at != k:
                a[[k, at]] = a[[at, k]]
                order[k], order[at] = order[at], order[k]
            if not a[k, k]:
                a[k, k] = size.scaleb(-digits + 5)
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k][:, None] * a[k, k + 1 :][None]

        def solve(b: np.ndarray) -> np.ndarray:
            y = b[order]
            for k in range(1, d):
                y[k] -= (a[k, :k] * y[:k]).sum()
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - ((a[k, k + 1 :] * y[k + 1 :]).sum() if k + 1 < d else 0)) / a[k, k]
            return y

        found = [np.array([Decimal((i * 7919 + (m + 1) * 104729 + i * i * (31 + m)) % 1009 - 504) for i in range(d)], object) for m in range(copies)]
        for _ in range(3):
            basis: list[np.ndarray] = []
            for v in found:
                v = solve(v)
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for u in basis:
                        v = v - u * (u * v).sum()
                basis.append(v / (v * v).sum().sqrt())
            found = basis
        return [list(v) for v in found]

