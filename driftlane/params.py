"""Parameters of the engine in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    """Production values; `small_sessions` has those for the short sessions of the sample tables."""

    train_end: str = "2023-12-31"
    validation_end: str = "2024-12-31"
    test_start: str = "2025-01-01"
    min_events: int = 50
    min_sessions: int = 10
    max_missing: float = 0.05
    top_kinds: int = 3
    window_sessions: int = 12
    min_prior: int = 5
    min_observations: int = 40
    ridge: float = 1e-4
    calibration: int = 20
    shrinkage: float = 0.35
    index_decay: float = 0.45
    index_floor: float = 5.0
    cusum_k: float = 0.5
    cusum_h: float = 4.5
    ewma_lambda: float = 0.2
    ewma_sigma: float = 2.8
    mean: float = 1.0
    std: float = 0.5
    label_groups: int = 3
    label_threshold: float = 0.45
    label_strong: int = 2
    label_free: int = 2
    horizon: int = 15
    allowance: float = 0.5
    bootstrap: int = 1000
    seed: int = 2025
    horizons: tuple[int, ...] = (10, 15, 20, 25)

    def __post_init__(self):
        for name in ("min_events", "window_sessions", "min_prior", "min_observations", "calibration", "horizon", "bootstrap", "label_groups"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("ridge", "std", "cusum_h", "index_decay"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        for name in ("shrinkage", "ewma_lambda", "max_missing"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not self.train_end < self.validation_end < self.test_start:
            raise ValueError("the splits must follow one another")
        if self.min_prior > self.window_sessions:
            raise ValueError("min_prior can't exceed window_sessions")
        if self.allowance < 0 or list(self.horizons) != sorted(set(self.horizons)) or not self.horizons:
            raise ValueError("allowance must not be negative; horizons must rise")

    @classmethod
    def from_mapping(cls, values: dict) -> "Params":
        """From a configuration; unknown and obsolete keys are refused."""
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


small_sessions = Params(
    train_end="1997-12-31", validation_end="1999-12-31", test_start="2000-01-01", min_events=10, min_sessions=5, calibration=5, horizon=6,
    mean=1.25, std=0.5, label_threshold=0.65, label_strong=2, label_free=3, horizons=(4, 6, 8, 10),
)
