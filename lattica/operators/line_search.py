"""Steps along a direction, for any function that gives its value and slope at a step.

:func:`strong_wolfe` keeps an interval that holds a suitable step, as More and Thuente, "Line search
algorithms with guaranteed sufficient decrease" (1994), describe it: section 2 states the interval and the
auxiliary function that is used until a step decreases the value enough, section 4 the trial values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

Phi = Callable[[float], tuple[float, float]]


@dataclass(frozen=True)
class Search:
    decrease: float = 1e-4
    curvature: float = 0.9
    width: float = 1e-16
    trials: int = 40
    least: float = 1e-20
    most: float = 1e20


@dataclass(frozen=True)
class Point:
    step: float
    f: float
    d: float  # slope along the direction

    def tilted(self, by: float) -> Point:
        """The same point of the function less ``by`` times the step."""
        return Point(self.step, self.f - by * self.step, self.d - by)


#: The trial must leave this much of an interval that shrinks too slowly; a fixed value of the paper.
SHRINK = 0.66
#: How far beyond the last step an open interval reaches; a fixed value of the paper.
GROWTH = 4.0


def _cubic(p: Point, q: Point) -> float:
    """Minimiser of the cubic through values and slopes of both points (nan if it has none)."""
    a = 3 * (p.f - q.f) / (q.step - p.step) + p.d + q.d
    size = max(abs(a), abs(p.d), abs(q.d)) or 1.0
    inside = (a / size) ** 2 - (p.d / size) * (q.d / size)
    if inside < 0:
        return math.nan
    root = size * math.sqrt(inside) * (1 if q.step > p.step else -1)
    bottom = q.d - p.d + 2 * root
    return q.step - (q.step - p.step) * (q.d + root - a) / bottom if bottom else math.nan


def _secant(p: Point, q: Point) -> float:
    return q.step - q.d * (q.step - p.step) / (q.d - p.d) if q.d != p.d else math.nan


def _parabola(p: Point, q: Point) -> float:
    """Minimiser of the parabola through both values and the slope of p."""
    return p.step + p.d / ((p.f - q.f) / (q.step - p.step) + p.d) / 2 * (q.step - p.step)


@dataclass(frozen=True)
class Bracket:
    """``best`` has the least value so far and its slope points to ``other``; while not ``closed``, the interval is open beyond it."""

    best: Point
    other: Point
    closed: bool = False

    def tilted(self, by: float) -> Bracket:
        return Bracket(self.best.tilted(by), self.other.tilted(by), self.closed)

    @property
    def size(self) -> float:
        return abs(self.other.step - self.best.step)

    def bounds(self, step: float) -> tuple[float, float]:
        if self.closed:
            return min(self.best.step, self.other.step), max(self.best.step, self.other.step)
        return self.best.step, step + GROWTH * (step - self.best.step)

    def with_point(self, now: Point) -> Bracket:
        """The interval after a value at ``now`` (the paper's updating algorithm)."""
        if now.f > self.best.f:
            return Bracket(self.best, now, True)
        if now.d * self.best.d < 0:
            return Bracket(now, self.best, True)
        return Bracket(now, self.other, self.closed)

    def trial(self, now: Point, lo: float, hi: float) -> float:
        """Where to look next after a value at ``now``: the rules of section 4."""
        best, kept = self.best, self.with_point(now)
        ahead = hi if now.step > best.step else lo
        near_an_end = False
        if now.f > best.f:
            c, s = _cubic(best, now), _parabola(best, now)
            found = c if abs(c - best.step) < abs(s - best.step) else (c + s) / 2
            near_an_end = True
        elif now.d * best.d < 0:
            c, s = _cubic(best, now), _secant(best, now)
            found = c if abs(c - now.step) >= abs(s - now.step) else s
        elif abs(now.d) < abs(best.d):
            c, s = _cubic(best, now), _secant(best, now)
            if not math.isfinite(c) or (c - now.step) * (now.step - best.step) < 0:
                c = ahead
            found = c if (abs(c - now.step) < abs(s - now.step)) == self.closed else s
            near_an_end = True
        else:
            found = _cubic(self.other, now) if self.closed else ahead
        if not math.isfinite(found):
            found = (kept.best.step + kept.other.step) / 2
        found = min(hi, max(lo, found))
        if kept.closed and near_an_end:
            edge = kept.best.step + SHRINK * (kept.other.step - kept.best.step)
            found = min(found, edge) if kept.other.step > kept.best.step else max(found, edge)
        return found


def strong_wolfe(phi: Phi, f: float, slope: float, step: float, p: Search = Search()) -> tuple[float, int] | None:
    """(step, evaluations) of a step that satisfies the strong Wolfe conditions, or None. ``f`` and ``slope`` are those at 0;
    the last step given to ``phi`` is the one returned."""
    if slope >= 0 or step <= 0:
        return None
    bracket, fell = Bracket(Point(0.0, f, slope), Point(0.0, f, slope)), False
    sizes = [2 * (p.most - p.least), p.most - p.least]
    for n in range(1, p.trials + 1):
        lo, hi = bracket.bounds(step)
        step = min(max(step, p.least), p.most)
        exhausted = bracket.closed and (not lo < step < hi or hi - lo <= p.width * hi)
        if exhausted:
            step = bracket.best.step
        now = Point(step, *phi(step))
        allowed = f + step * p.decrease * slope
        if now.f <= allowed and abs(now.d) <= -p.curvature * slope:
            return step, n
        if exhausted or (step == p.least and (now.f > allowed or now.d >= p.decrease * slope)):
            return None
        fell = fell or (now.f <= allowed and now.d >= min(p.decrease, p.curvature) * slope)
        # until a step falls enough, the function less its allowed decrease is what is bracketed
        tilt = p.decrease * slope if not fell and allowed < now.f <= bracket.best.f else 0.0
        view, seen = bracket.tilted(tilt), now.tilted(tilt)
        step, bracket = view.trial(seen, lo, hi), view.with_point(seen).tilted(-tilt)
        if bracket.closed:
            if bracket.size >= SHRINK * sizes[-2]:
                step = bracket.best.step + 0.5 * (bracket.other.step - bracket.best.step)
            sizes.append(bracket.size)
    return None


def backtracking(phi: Phi, f: float, slope: float, step: float, p: Search = Search(), wolfe: str = "armijo") -> tuple[float, int] | None:
    """The same by shrinking and growing a step; ``wolfe`` is armijo, weak or strong."""
    if slope >= 0:
        return None
    for n in range(1, p.trials + 1):
        value, d = phi(step)
        if value > f + step * p.decrease * slope:
            step *= 0.5
        elif wolfe == "armijo" or (d >= p.curvature * slope and (wolfe == "weak" or d <= -p.curvature * slope)):
            return step, n
        else:
            step *= 2.1 if d < p.curvature * slope else 0.5
        if not p.least <= step <= p.most:
            return None
    return None
