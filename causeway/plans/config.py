"""Configuration: defaults as a dataclass, YAML where the library is there, JSON anywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Config:
    seed: int = 42
    unlabeled_modulo: int = 1000
    n_folds: int = 4
    min_train_weeks: int = 8
    recall_ks: tuple[int, ...] = (100, 500, 1000)
    use_unlabeled: bool = True
    unlabeled_weight: float = 0.01
    reviewed_negative_weight: float = 1.0
    history_window_events: int | None = None
    ultra_burst: bool = True
    fingerprint_novelty: bool = True
    geo_lang_drift: bool = True
    session_fallback: bool = True
    pretrain_profile: bool = True
    full_week_eval: bool = True
    use_sequence: bool = True
    graph_mode: str = "full"
    graph_prior: float | str = 0.5
    graph_alpha: float = 20.0
    booster: str = "gbt"
    min_child_weight: float = 8.0
    columns_by_tree: float = 0.85
    reg_lambda: float = 1.0
    tracking: bool = True
    max_labeled_rows: int | None = None
    max_unlabeled_rows: int | None = None
    max_test_rows: int | None = None
    max_eval_week_rows: int | None = None
    max_event_rows: int | None = None
    sequence_length: int = 128
    sequence_stride: int = 32
    sequence_least: int = 8

    def override(self, **values) -> Config:
        """A copy with the given values; None keeps the default, an unknown name raises."""
        names = {f.name for f in fields(self)}
        if unknown := set(values) - names:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        if values.get("graph_mode") not in (None, "off", "count", "full"):
            raise ValueError(f"unknown graph mode {values['graph_mode']}")
        return Config(**asdict(self) | {k: v for k, v in values.items() if v is not None})


def switch(mode: str, default: bool) -> bool:
    """config, true or false."""
    if mode not in ("config", "true", "false"):
        raise ValueError(f"unknown mode {mode}")
    return default if mode == "config" else mode == "true"


def load(path: str) -> Config:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs the yaml package; use JSON") from e
        return Config().override(**(yaml.safe_load(text) or {}))
    return Config().override(**json.loads(text))
