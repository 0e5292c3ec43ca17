"""The rule of the trajectory sampler for two positions (t, lat, lon, course, speed)."""

from __future__ import annotations

import math


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((math.radians(lon2) - math.radians(lon1)) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def absent(x) -> bool:
    return x is None or math.isnan(x)


def far_apart(old, new, period: float, distance: float, knots: float, course: float) -> bool:
    if new[0] - old[0] > period or metres(old[1], old[2], new[1], new[2]) > distance:
        return True
    if any(map(absent, (old[3], old[4], new[3], new[4]))):
        return True
    return abs(new[3] - old[3]) > course or abs(new[4] - old[4]) > knots
