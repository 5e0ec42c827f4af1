"""The pseudolikelihood where each row leaves out some of the parameters at random.

Whether a row keeps a parameter is a hash of the row's codes, the parameter's number and the seed, so a mask needs no
room: each task makes the bits that it uses again, and they are the same on any partitioning. Both predictions of a pair
of sites share the bits of its couplings. Equal rows are one row with the sum of their weights.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from lattica.operators.tiled import BlockRow, Layout, TiledObjective

#: Cells (row, site, own site, code) whose bits are made at once.
CELLS = 1 << 21


def mixed(h: np.ndarray) -> np.ndarray:
    """Steele, Lea and Flood's 64-bit finaliser (2014)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_keys(codes: np.ndarray, seed: int) -> np.ndarray:
    """A key of each row, from its codes."""
    out = np.full(len(codes), mixed(np.array([seed], np.uint64))[0], np.uint64)
    for column in codes.T:
        out = mixed(out + (column.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def kept(keys: np.ndarray, parameters: np.ndarray, keep: float) -> np.ndarray:
    """Whether rows with ``keys`` keep ``parameters`` (numbers; both broadcast)."""
    h = mixed(keys + mixed(parameters.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < keep


def coupling_numbers(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, n_sites: int, q: int) -> np.ndarray:
    """The number of e_ij(a, b), the same as that of e_ji(b, a); fields come before."""
    first = i < j
    lo, hi = np.minimum(i, j), np.maximum(i, j)
    return n_sites * q + ((lo * n_sites + hi) * q + np.where(first, a, b)) * q + np.where(first, b, a)


class DroppedBlockRow(BlockRow):
    def __init__(self, layout: Layout, block: int, task: int, seed: int, keep: float, scaled: bool) -> None:
        super().__init__(layout, block, task)
        self.seed, self.keep, self.scale = seed, keep, 1 / keep if scaled else 1.0

    def meet(self, codes: bytes, w: np.ndarray) -> None:
        s, q = self.layout, self.layout.q
        codes = np.frombuffer(codes, np.int8 if q <= 127 else np.int32).reshape(len(w), s.n_sites).astype(np.int64)
        if self.grad is None:
            self.grad = np.zeros((s.n_sites * q, s.size(self.block) * q))
        grad = self.grad.reshape(self.e.shape)
        own = np.arange(s.n_sites)[s.sites(self.block)]
        every, letters = np.arange(s.n_sites), np.arange(q)
        step = max(1, CELLS // (s.n_sites * len(own) * q))
        for at in range(0, len(w), step):
            part, weight = codes[at : at + step], w[at : at + step]
            keys = row_keys(part, self.seed)
            h_bits = kept(keys[:, None, None], own[:, None] * q + letters, self.keep) * self.scale
            there = np.maximum(part, 0)  # a gap pulls nothing
            numbers = coupling_numbers(own[None, None, :, None], every[None, :, None, None], letters[None, None, None, :], there[:, :, None, None], s.n_sites, q)
            bits = kept(keys[:, None, None, None], numbers, self.keep) * self.scale
            bits = bits * ((part >= 0)[:, :, None, None] & (every[:, None] != own)[None, :, :, None])
            energy = self.h * h_bits + (self.e[every, there] * bits).sum(axis=1)
            top = energy.max(axis=2, keepdims=True)
            p = np.exp(energy - top)
            z = p.sum(axis=2, keepdims=True)
            p /= z
            mine = part[:, own]
            rows, sites = np.nonzero(mine >= 0)
            log_p = energy[rows, sites, mine[rows, sites]] - (np.log(z) + top)[rows, sites, 0]
            self.value -= float((weight[rows] * log_p).sum())
            off = p * (mine >= 0)[:, :, None]
            off[rows, sites, mine[rows, sites]] -= 1
            off *= weight[:, None, None]
            self.grad_h += (off * h_bits).sum(axis=0)
            pulls = off[:, None] * bits
            for c in range(q):
                grad[:, c] += np.einsum("nl,nlma->lma", (part == c).astype(np.float64), pulls)


class DropoutObjective(TiledObjective):
    """``keep`` is the share of parameters that a row keeps; ``scaled`` divides what it keeps by that, so that energies are
    right on average. ``seed`` chooses the masks: change it between steps of a stochastic fit."""

    def __init__(self, rows: DataFrame, layout: Layout, lambda_h: float, lambda_group: float = 0.0, parts: int | None = None, seed: int = 42, keep: float = 0.5, scaled: bool = False) -> None:
        super().__init__(rows, layout, lambda_h, lambda_group, parts)
        self.block_row = partial(DroppedBlockRow, seed=seed, keep=keep, scaled=scaled)
