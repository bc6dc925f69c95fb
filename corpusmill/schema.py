"""Declared schemas of the tables that operators read and write, and their record types."""

from __future__ import annotations

from dataclasses import dataclass, field

DOCUMENT = "dataset_id string, uid string, title string, text string, label int, label_raw string, source_file string"
MAPPING_REPORT = "dataset_id string, n_raw long, n_missing long, n_ambiguous long, n_kept long, n_fake long, n_real long"
DEDUP_REPORT = "dataset_id string, n_before long, n_exact_removed long, n_near_removed long, n_kept long, pct_removed double"
OVERLAP_REPORT = "train_id string, test_id string, n_test_before long, n_removed long, n_test_after long, pct_removed double, note string"
STATS = "dataset_id string, version string, part string, seed int, n long, n_fake long, n_real long, fake_ratio double, mean_chars double, median_chars double, mean_words double, median_words double"
SPLIT = "dataset_id string, regime string, seed int, part string, row_pos long"
PREDICTION = "model_id string, seed int, row_pos long, y_true int, y_pred int, y_prob double"
COMPARISON = "a string, b string, mean_diff double, ci_low double, ci_high double, p_value double, mcnemar_b long, mcnemar_c long, mcnemar_stat double, mcnemar_p double, cliffs_delta double"
SNAPSHOT = "dataset_id string, status string, digest string, n_files long, n_bytes long"
EPOCH_LOG = "epoch int, train_loss double, val_macro_f1 double, learning_rate double, improved boolean, stop boolean"
# The columns of a headerless statement file, in order.
STATEMENT_COLUMNS = [
    "id", "label", "statement", "subject", "speaker", "job_title", "state_info", "party", "barely_true_counts",
    "false_counts", "half_true_counts", "mostly_true_counts", "pants_on_fire_counts", "context",
]
STATEMENT = ", ".join(f"{c} string" for c in STATEMENT_COLUMNS)
PROVENANCE = ["experiment_id", "run_id", "model_id", "dataset_id", "train_version", "test_version", "split_regime", "seed"]


@dataclass(frozen=True)
class SequenceParams:
    """Window settings of a token sequence model."""

    window_tokens: int = 512
    stride_tokens: int = 128
    special_tokens: int = 2
    title_only_tokens: int = 64

    @property
    def content(self) -> int:
        return self.window_tokens - self.special_tokens


@dataclass(frozen=True)
class MappingSpec:
    """Tokens of a corpus that mean fake and real; fake wins where a token is in both."""

    dataset_id: str
    fake: tuple[str, ...]
    real: tuple[str, ...]
    explicit: bool = True


@dataclass(frozen=True)
class ClassicalResult:
    """Outcome of a grid search."""

    model_id: str
    best_params: dict
    val_macro_f1: float
    trials: list = field(default_factory=list)
