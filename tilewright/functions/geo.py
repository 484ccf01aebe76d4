"""Coordinate systems and plane geometry in numpy: WGS84, Web Mercator, UTM; polygon against box."""

from __future__ import annotations

import math
import re

import numpy as np

A, INVERSE_F = 6_378_137.0, 298.257223563  # WGS84


def epsg(crs: str) -> int:
    m = re.fullmatch(r"(?i)\s*(?:EPSG:|urn:ogc:def:crs:EPSG::)(\d+)\s*", crs or "")
    code = int(m[1]) if m else -1
    if code in (4326, 3857) or 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return code
    raise ValueError(f"unsupported CRS {crs!r}")


def is_geographic(crs: str) -> bool:
    return epsg(crs) == 4326


def forward(crs: str, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees to the system's x and y."""
    code = epsg(crs)
    lon, lat = np.asarray(lon, dtype=float), np.asarray(lat, dtype=float)
    if code == 4326:
        return lon, lat
    if code == 3857:
        return np.radians(lon) * A, A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    zone, south = code % 100, code >= 32700
    f = 1 / INVERSE_F
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500_000 + 0.9996 * radius * x, (10_000_000 if south else 0) + 0.9996 * radius * y


def polygons(region: dict) -> list[list[np.ndarray]]:
    """Polygons (rings of points) of a GeoJSON Polygon or MultiPolygon; a Feature is unwrapped."""
    if region.get("type") == "Feature":
        region = region.get("geometry") or {}
    if region.get("type") == "Polygon":
        parts = [region["coordinates"]]
    elif region.get("type") == "MultiPolygon":
        parts = region["coordinates"]
    else:
        raise ValueError(f"region must be a Polygon or MultiPolygon, not {region.get('type')!r}")
    out = [[np.asarray(r, dtype=float)[:, :2] for r in part] for part in parts]
    if not out or any(not part or len(r) < 4 for part in out for r in part):
        raise ValueError("a ring needs four points or more")
    return out


def project(parts: list[list[np.ndarray]], crs: str) -> list[list[np.ndarray]]:
    """Vertex by vertex, without densifying."""
    return [[np.stack(forward(crs, r[:, 0], r[:, 1]), axis=1) for r in part] for part in parts]


def extent(parts: list[list[np.ndarray]]) -> tuple[float, float, float, float]:
    points = np.concatenate([p[0] for p in parts])
    return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule; points on the edge may go either way (edges are tested by themselves)."""
    out = np.zeros(len(x), dtype=bool)
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
        if y0 != y1:
            out ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def crosses(ring: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Boxes (n x 4) that an edge of the ring touches (closed sets), by clipping each edge."""
    out = np.zeros(len(boxes), dtype=bool)
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
        low, high, ok = np.zeros(len(boxes)), np.ones(len(boxes)), np.ones(len(boxes), dtype=bool)
        for d, start, a, b in ((x1 - x0, x0, boxes[:, 0], boxes[:, 2]), (y1 - y0, y0, boxes[:, 1], boxes[:, 3])):
            if d == 0:
                ok &= (a <= start) & (start <= b)
            else:
                t0, t1 = (a - start) / d, (b - start) / d
                low, high = np.maximum(low, np.minimum(t0, t1)), np.minimum(high, np.maximum(t0, t1))
        out |= ok & (low <= high)
    return out


def intersects(parts: list[list[np.ndarray]], boxes: np.ndarray) -> np.ndarray:
    """Boxes (xmin, ymin, xmax, ymax) that share a point with the polygons; touching counts."""
    out = np.zeros(len(boxes), dtype=bool)
    for part in parts:
        for ring in part:
            out |= crosses(ring, boxes)
        within = inside(part[0], boxes[:, 0], boxes[:, 1])
        for hole in part[1:]:
            within &= ~inside(hole, boxes[:, 0], boxes[:, 1])
        first = part[0][0]
        out |= within | ((boxes[:, 0] <= first[0]) & (first[0] <= boxes[:, 2]) & (boxes[:, 1] <= first[1]) & (first[1] <= boxes[:, 3]))
    return out
