"""Typed settings of the operators. Defaults are fixed values of the modelled pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column roles of the labelled traffic table.
LABEL = "label"
FAMILY = "attack_family"
SOURCE = "source_file"
METADATA = (LABEL, FAMILY, SOURCE)
BENIGN = "benign"
SEED = 42


@dataclass(frozen=True)
class PrepConfig:
    impute_strategy: str = "median"  # median, mean, most_frequent or constant
    impute_constant: float = 0.0
    clip_quantiles: tuple[float, float] = (0.001, 0.999)
    scale: bool = True

    def __post_init__(self) -> None:
        if self.impute_strategy not in ("median", "mean", "most_frequent", "constant"):
            raise ValueError(f"unknown impute strategy: {self.impute_strategy}")
        low, high = self.clip_quantiles
        if not 0.0 <= low < high <= 1.0:
            raise ValueError("clip quantiles must satisfy 0 <= low < high <= 1")


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.20
    val_size: float = 0.10
    seed: int = SEED

    def __post_init__(self) -> None:
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie strictly between 0 and 1")
        if not 0 < self.val_size < 1:
            raise ValueError("val_size must lie strictly between 0 and 1")
        if self.test_size + self.val_size >= 1:
            raise ValueError("test_size and val_size must sum to less than 1")


@dataclass(frozen=True)
class FoldConfig:
    label: str = LABEL
    benign: str = BENIGN
    benign_test_size: float = 0.3
    seed: int = SEED


@dataclass(frozen=True)
class DriftConfig:
    psi_threshold: float = 0.2
    ks_pvalue_threshold: float = 0.05
    bins: int = 10
    f1_drop: float = 0.05
    auroc_drop: float = 0.05
    confidence_shift: float = 0.10
    # Kolmogorov-Smirnov p-values are exact up to this many values on each side.
    ks_exact_rows: int = 10_000
    min_reference_rows: int = 0  # opt-in guard; 0 switches it off


@dataclass(frozen=True)
class RetrainingPolicy:
    enabled: bool = True
    auto_trigger: bool = False
    min_severity: str = "high"


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 50
    depth: int = 4
    learning_rate: float = 0.1
    row_subsample: float = 0.8
    column_subsample: float = 0.8
    max_bins: int = 256
    early_stopping: bool = True
    seed: int = SEED
    # Leaf penalties and rounds without a lower loss, of the softmax booster.
    alpha: float = 0.0
    reg_lambda: float = 1.0
    patience: int = 10


@dataclass(frozen=True)
class AutoencoderConfig:
    hidden: tuple[int, ...] = (128, 64)
    latent: int = 32
    batch_size: int = 256
    epochs: int = 18
    learning_rate: float = 5e-3
    weight_decay: float = 1e-4
    seed: int = SEED
    # Networks trained side by side and averaged after each epoch. Part of the model, like the seed.
    replicas: int = 8

    def __post_init__(self) -> None:
        if self.replicas < 1:
            raise ValueError("replicas must be positive")


@dataclass(frozen=True)
class DualConfig:
    alpha: float = 0.6
    beta: float = 0.4
    threshold_quantile: float = 0.95

    def __post_init__(self) -> None:
        if self.alpha + self.beta <= 0:
            raise ValueError("alpha + beta must be positive")


@dataclass(frozen=True)
class FusionConfig:
    c: float = 1.0
    max_iter: int = 1000
    balanced: bool = True


@dataclass(frozen=True)
class GateThresholds:
    """Promotion gates; every gate is off (0.0) unless a value is given."""

    min_fusion_f1: float = 0.0
    min_fusion_auroc: float = 0.0
    min_loao_mean_f1: float = 0.0
    min_loao_min_f1: float = 0.0
    min_fusion_over_baseline_gap: float = 0.0


# The promotion gates that are configured by default.
PROMOTION_GATES = GateThresholds(0.70, 0.70, 0.65, 0.50, 0.02)


@dataclass(frozen=True)
class SloPolicy:
    p50_ms: float = 20.0
    p95_ms: float = 50.0
    p99_ms: float = 100.0
    error_rate: float = 0.02
    throughput_rps: float = 1000.0
    confidence: float = 0.55


@dataclass(frozen=True)
class HybridConfig:
    boost: BoostConfig = field(default_factory=BoostConfig)
    autoencoder: AutoencoderConfig = field(default_factory=AutoencoderConfig)
    dual: DualConfig = field(default_factory=DualConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)
    weighting: str = "ones"  # ones, importance or shap
    multiclass: bool = True  # one boosted model per class, or benign against all attacks
    attribution_rows: int | None = None  # None: all training rows
    softmax: bool = False  # one softmax booster of all classes in place of one binary model for each
