"""Settings of the engine and of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """What holds for every run. ``budget_tokens`` names the counter that budgets are kept in
    (``budget`` or ``attention``)."""

    max_seq_len: int = 32_768
    min_word_length: int = 1
    use_threshold_by_default: bool = False
    default_threshold: float = 0.5
    disable_chunking: bool = False
    budget_tokens: str = "budget"

    def __post_init__(self):
        if self.budget_tokens not in ("budget", "attention"):
            raise ValueError("budget_tokens is 'budget' or 'attention'")
        if self.max_seq_len < 1:
            raise ValueError("max_seq_len must be positive")


@dataclass(frozen=True)
class CompressOptions:
    """What a run asks for. A positive ``target_token`` goes before ``compression_rate``."""

    target_token: int = -1
    compression_rate: float = 0.5
    use_threshold_filtering: bool = False
    threshold: float = 0.5

    def __post_init__(self):
        if not 0.0 <= self.compression_rate <= 1.0:
            raise ValueError("compression_rate lies between 0 and 1")
