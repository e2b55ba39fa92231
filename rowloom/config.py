"""Parameters of the build and evaluation jobs, with their published default values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SerializerConfig:
    numeric_precision: int = 2
    model_max_len_tokens: int = 4096
    appx_chars_per_token: float = 3.5

    @property
    def max_chars(self) -> int:
        return int(self.model_max_len_tokens * self.appx_chars_per_token)


@dataclass(frozen=True)
class RetrievalConfig:
    num_queries_per_type: int = 1000
    min_matches: int = 5
    max_conditions: int = 3
    numeric_precision: int = 2
    max_samples_per_dataset: int | None = 1000


@dataclass(frozen=True)
class ClassificationConfig:
    max_samples_per_dataset: int | None = None
    train_ratio: float = 0.8
    max_label_ratio: float = 0.1
    max_num_labels: int = 50


@dataclass(frozen=True)
class BuildConfig:
    random_seed: int = 42
    min_samples: int = 100
    benchmarks: tuple[str, ...] | None = None
    serializer: SerializerConfig = field(default_factory=SerializerConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    classification: ClassificationConfig = field(default_factory=ClassificationConfig)


@dataclass(frozen=True)
class EvalConfig:
    tasks: tuple[str, ...] = ("classification", "retrieval")
    batch_size: int = 64
    retrieval_index_type: str = "flat"
    retrieval_top_k: tuple[int, ...] = (1, 5, 10, 20, 50, 100)
    benchmarks: tuple[str, ...] | None = None
    datasets: tuple[str, ...] | None = None
