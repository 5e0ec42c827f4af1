"""Optimizers on the driver, for models of few parameters: limited-memory BFGS and Adam.
Larger models are fitted by :mod:`lattica.operators.tiled`."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import numpy as np

from lattica.operators.line_search import Search, backtracking, strong_wolfe

Function = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Status(Enum):
    CONVERGED = "converged"
    ALREADY_MINIMAL = "already minimal"
    MAX_ITERATIONS = "iteration limit"
    LINE_SEARCH = "line search found no step"


@dataclass
class Result:
    x: np.ndarray
    value: float
    status: Status
    #: One entry per iteration: iteration, value, size of gradient, of x, step, evaluations.
    history: list[dict] = field(default_factory=list)


def _along(fn: Function, x: np.ndarray, direction: np.ndarray, seen: dict):
    """Value and slope of ``fn`` along a direction; the last point stays in ``seen``."""
    def phi(step: float) -> tuple[float, float]:
        seen["x"] = x + step * direction
        seen["f"], seen["g"] = fn(seen["x"])
        return seen["f"], float(seen["g"] @ direction)

    return phi


def _step(search, fn: Function, x: np.ndarray, f: float, g: np.ndarray, direction: np.ndarray, step: float):
    """(x, f, g, step, evaluations), or None."""
    seen: dict = {}
    found = search(_along(fn, x, direction, seen), f, float(g @ direction), step)
    return found and (seen["x"], seen["f"], seen["g"], *found)


def wolfe_step(fn: Function, x: np.ndarray, f: float, g: np.ndarray, direction: np.ndarray, step: float):
    return _step(strong_wolfe, fn, x, f, g, direction, step)


def backtracking_step(fn: Function, x: np.ndarray, f: float, g: np.ndarray, direction: np.ndarray, step: float):
    return _step(backtracking, fn, x, f, g, direction, step)


def lbfgs(fn: Function, x: np.ndarray, max_iter: int = 0, epsilon: float = 1e-3, memory: int = 6, search=wolfe_step, l1: float = 0.0, l1_from: int = 0, n_fields: int = 0) -> Result:
    """Minimise ``fn``; stops when the gradient is ``epsilon`` of max(1, size of x). The history has the sizes of the
    first ``n_fields`` entries and of the others by themselves as well.

    ``l1`` adds an L1 penalty on x[l1_from:] by the orthant-wise method (Andrew and Gao 2007)."""
    began, x = time.monotonic(), x.copy()
    f, g = fn(x)
    penalised = (lambda z, v: v + l1 * float(np.abs(z[l1_from:]).sum())) if l1 else (lambda z, v: v)
    f = penalised(x, f)
    pseudo = _pseudo_gradient(x, g, l1, l1_from)
    result = Result(x, f, Status.CONVERGED)
    if np.linalg.norm(pseudo) <= epsilon * max(1.0, np.linalg.norm(x)):
        result.status = Status.ALREADY_MINIMAL
        return result
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    step, t = 1 / np.linalg.norm(pseudo), 0
    while True:
        direction = -_two_loops(pseudo, pairs)
        if l1:
            tail = direction[l1_from:]
            tail[tail * pseudo[l1_from:] >= 0] = 0
            found = _orthant_step(fn, penalised, x, f, pseudo, direction, step, l1_from)
        else:
            found = search(fn, x, f, g, direction, step)
        if found is None:
            result.x, result.value, result.status = x, f, Status.LINE_SEARCH
            return result
        new, f, new_g, step, evaluations = found
        t += 1
        s, y = new - x, new_g - g
        x, g = new, new_g
        pseudo = _pseudo_gradient(x, g, l1, l1_from)
        norm_x, norm_g = float(np.linalg.norm(x)), float(np.linalg.norm(pseudo))
        result.history.append({"iteration": t, "value": f, "gradient": norm_g, "size": norm_x, "step": float(step), "evaluations": evaluations} | _progress(began, x, pseudo, n_fields))
        result.x, result.value = x, f
        if norm_g <= epsilon * max(1.0, norm_x):
            return result
        if max_iter and t >= max_iter:
            result.status = Status.MAX_ITERATIONS
            return result
        sy = float(s @ y)
        if sy > 0:
            pairs.append((s, y, sy))
        step = 1.0


def _two_loops(g: np.ndarray, pairs) -> np.ndarray:
    """The inverse Hessian of the remembered pairs times g."""
    out, kept = g.copy(), []
    for s, y, sy in reversed(pairs):
        a = float(s @ out) / sy
        out -= a * y
        kept.append(a)
    if pairs:
        _, y, sy = pairs[-1]
        out *= sy / float(y @ y)
    for (s, y, sy), a in zip(pairs, reversed(kept), strict=True):
        out += (a - float(y @ out) / sy) * s
    return out


def _pseudo_gradient(x: np.ndarray, g: np.ndarray, l1: float, at: int) -> np.ndarray:
    if not l1:
        return g
    out, z, d = g.copy(), x[at:], g[at:]
    out[at:] = np.where(z < 0, d - l1, np.where(z > 0, d + l1, np.where(d < -l1, d + l1, np.where(d > l1, d - l1, 0.0))))
    return out


def _orthant_step(fn, penalised, x, f, pseudo, direction, step, at, p: Search = Search()):
    orthant = np.where(x[at:] != 0, np.sign(x[at:]), np.sign(-pseudo[at:]))
    for n in range(1, p.trials + 1):
        new = x + step * direction
        new[at:][new[at:] * orthant <= 0] = 0
        value, grad = fn(new)
        value = penalised(new, value)
        if value <= f + p.decrease * float(pseudo @ (new - x)):
            return new, value, grad, step, n
        step *= 0.5
    return None


def _progress(began: float, x: np.ndarray, g: np.ndarray, n: int) -> dict:
    norm = lambda v: float(np.linalg.norm(v))
    return {"seconds": time.monotonic() - began, "h_norm": norm(x[:n]), "e_norm": norm(x[n:]), "h_gradient": norm(g[:n]), "e_gradient": norm(g[n:])}


def adam(fn: Function, x: np.ndarray, max_iter: int, compat: bool = False, rate: float = 0.01, stop: float = 0.01, n_fields: int = 0) -> Result:
    """Adam with rate halved every 50 steps; returns the running mean of x. At least one step is
    taken. The mean is corrected for its start at zero unless ``compat``."""
    first, second, mean = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    x, history, t, began = x.copy(), [], 0, time.monotonic()
    while True:
        t += 1
        f, g = fn(x)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        x = x - rate * 0.5 ** (t // 50) * step
        mean = 0.9 * mean + 0.1 * x
        slope = float(np.abs(first / (1 - 0.9**t)).mean())
        history.append({"iteration": t, "value": f, "gradient": slope, "size": float(np.linalg.norm(x)), "step": rate, "evaluations": 1} | _progress(began, x, g, n_fields))
        if slope <= stop or t >= max_iter:
            out = mean if compat else mean / (1 - 0.9**t)
            return Result(out, f, Status.CONVERGED if slope <= stop else Status.MAX_ITERATIONS, history)
