"""Equal-area metres from longitude and latitude as SQL text, the same for Spark and DuckDB."""

from __future__ import annotations

import math

#: GRS80 ellipsoid; standard parallels, origin and false northing of EPSG:3311.
_A, _F = 6378137.0, 1 / 298.257222101
_PARALLEL_1, _PARALLEL_2, _ORIGIN_LAT, _ORIGIN_LON, _NORTHING = 34.0, 40.5, 0.0, -120.0, -4000000.0

_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sin: float) -> float:
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m2(phi: float) -> float:
    return math.cos(phi) ** 2 / (1 - _E2 * math.sin(phi) ** 2)


_P1, _P2 = math.radians(_PARALLEL_1), math.radians(_PARALLEL_2)
_N = (_m2(_P1) - _m2(_P2)) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
_C = _m2(_P1) + _N * _q(math.sin(_P1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.sin(math.radians(_ORIGIN_LAT)))) / _N


def _d(v: float) -> str:
    return f"cast({v!r} as double)"


def project(lon: str, lat: str) -> tuple[str, str]:
    """SQL texts of x and y for degrees; null in, null out. No datum shift is made."""
    s = f"sin(radians({lat}))"
    q = f"({_d(1 - _E2)} * ({s} / (1 - {_d(_E2)} * {s} * {s}) - ln((1 - {_d(_E)} * {s}) / (1 + {_d(_E)} * {s})) / {_d(2 * _E)}))"
    rho = f"({_d(_A / _N)} * sqrt({_d(_C)} - {_d(_N)} * {q}))"
    theta = f"({_d(_N)} * radians({lon} - {_d(_ORIGIN_LON)}))"
    return f"({rho} * sin({theta}))", f"({_d(_RHO0 + _NORTHING)} - {rho} * cos({theta}))"


def unproject(x: str, y: str) -> tuple[str, str]:
    """SQL texts of longitude and latitude for metres; null in, null out.

    The latitude of equal area goes back by its series, and one step of Newton's method on the exact relation makes the
    error smaller than a double can tell.
    """
    dy = f"({_d(_RHO0 + _NORTHING)} - {y})"
    q = f"(({_d(_C)} - ({x} * {x} + {dy} * {dy}) * {_d((_N / _A) ** 2)}) / {_d(_N)})"
    beta = f"asin(greatest({_d(-1.0)}, least({_d(1.0)}, {q} / {_d(_q(1.0))})))"
    series = ((2, _E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040), (4, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780), (6, 761 * _E2**3 / 45360))
    phi = f"({beta} + " + " + ".join(f"{_d(c)} * sin({k} * {beta})" for k, c in series) + ")"
    s = f"sin({phi})"
    w = f"(1 - {_d(_E2)} * {s} * {s})"
    step = f"({w} * {w} / (2 * cos({phi})) * ({q} / {_d(1 - _E2)} - {s} / {w} + ln((1 - {_d(_E)} * {s}) / (1 + {_d(_E)} * {s})) / {_d(2 * _E)}))"
    return f"({_d(_ORIGIN_LON)} + degrees(atan2({x}, {dy})) / {_d(_N)})", f"degrees({phi} + {step})"
