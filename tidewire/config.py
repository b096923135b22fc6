"""Settings of extraction and training."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ExtractConfig:
    """Window lengths in packets, thresholds in seconds."""

    small: int = 100
    large: int = 500
    inner: int = 20
    burst: float = 0.01
    silence: float = 0.1
    ema_alpha: float = 0.1
    flow_bins: int = 50
    entropy_bins: int = 10
    #: Compare message types by name as well as by number; off, a ratio of named types stays 0 for numbered ones.
    message_numbers: bool = True
    #: Rows of one block of a capture; windows of a block see the rows before it as well.
    block: int = 4_000

    def __post_init__(self) -> None:
        if not 1 <= self.small <= self.large:
            raise ValueError("the small window must not be longer than the large one")


@dataclass(frozen=True)
class TrainConfig:
    """Sampling, splitting, selection, search and evaluation."""

    files: int = 120
    shares: dict[str, float] = field(default_factory=lambda: {"normal_order": 0.3, "normal_stock": 0.3, "anomalous_order": 0.2, "anomalous_stock": 0.2})
    test_share: float = 0.2
    validation_share: float = 0.2
    scaler_share: float = 0.3
    mqtt_only: bool = True
    impute: float = 0.0
    redundancy: float = 0.95
    leakage: float = 0.9
    stability_rows: int = 1_000
    folds: int = 5
    trials: int = 25
    bootstrap: int = 1_000
    confidence: float = 0.95
    seed: int = 42
    scale_on_train_only: bool = True


def as_json(*configs: object) -> dict:
    """Settings as plain values, for a run's record."""
    return {type(c).__name__: asdict(c) for c in configs}
