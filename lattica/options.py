"""Settings of a model fit."""

from __future__ import annotations

from dataclasses import dataclass

#: Gap and amino acids by letter; a fixed value.
DEFAULT_LETTERS = "-ACDEFGHIKLMNPQRSTVWY"


@dataclass(frozen=True)
class Options:
    """Defaults as the command line has them.

    ``theta`` outside [0, 1] turns reweighting off. ``max_iter`` 0 means no bound for
    L-BFGS. ``compat`` selects the reference behaviour where the documented maths
    differs: the uncorrected running average of the stochastic optimizer, biased
    reservoir sampling, and neighbour counts divided by the scale twice.
    """

    letters: str | None = None
    focus: str | None = None
    theta: float = 0.2
    scale: float = 1.0
    lambda_h: float = 0.01
    lambda_e: float = 100.0
    lambda_group: float = 0.0
    gap_reduce: bool = False
    max_iter: int = 0
    stochastic: bool = False
    clusters: int = 0
    batch: int = 2048
    two_stage: bool = False
    epsilon: float = 1e-3
    history: int = 6
    seed: int = 42
    compat: bool = False
    #: Codes times sites, and parameters, up to which a fit is steered by the driver; beyond either, by tiles on the executors.
    local_cells: int = 4_000_000_000
    local_parameters: int = 2_000_000
    #: Codes times sites up to which the driver holds the rows of such a fit as well. Beyond, they stay on the executors: tasks send
    #: their sums of up to ``shared_parameters``, and larger models are fitted by tiles.
    driver_cells: int = 1_000_000
    shared_parameters: int = 250_000
    #: Sites in a block of a tiled fit, None for as many as the bound on a block row allows.
    site_block: int | None = None

    @property
    def alphabet(self) -> str:
        return self.letters or DEFAULT_LETTERS

    @property
    def default_alphabet(self) -> bool:
        """Whether the built-in letters are in use; the same letters given explicitly don't count."""
        return self.letters is None
