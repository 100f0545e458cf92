"""Settings of the pipeline: a dataclass, optionally filled from a YAML file."""

from __future__ import annotations

import dataclasses
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Settings:
    start_year: int = 2010
    end_year: int = 2025
    max_records: int | None = None
    source_sample_limit: int = 10_000
    seed: int = 42
    fuzzy_threshold: float = 90.0
    holdout_size: int = 2000
    n_clusters: int = 30
    vocabulary_size: int = 50_000
    min_df: int = 3
    svd_components: int = 256
    early_years: tuple[int, int] = (2013, 2016)
    recent_years: tuple[int, int] = (2018, 2020)
    embedding_backend: str = "tfidf"
    contact_email: str = ""
    work_types: tuple[str, ...] = ()
    ai_terms: tuple[str, ...] = ()
    bio_terms: tuple[str, ...] = ()
    baseline_terms: tuple[str, ...] = ()
    llm_sample_size: int = 300
    gold_size: int = 150


# Where the nested layout of a settings file (section, key) keeps each setting.
NESTED = {
    ("project", "contact_email"): "contact_email", ("corpus", "start_year"): "start_year", ("corpus", "end_year"): "end_year",
    ("corpus", "work_types"): "work_types", ("corpus", "max_records"): "max_records", ("corpus", "ai_terms"): "ai_terms",
    ("corpus", "bio_terms"): "bio_terms", ("corpus", "baseline_terms"): "baseline_terms", ("topics", "n_clusters"): "n_clusters",
    ("topics", "random_state"): "seed", ("topics", "early_window"): "early_years", ("topics", "recent_window"): "recent_years",
    ("topics", "embedding_backend"): "embedding_backend", ("entity_resolution", "fuzzy_threshold"): "fuzzy_threshold",
    ("entity_resolution", "holdout_size"): "holdout_size", ("llm_classification", "sample_size"): "llm_sample_size",
    ("llm_classification", "gold_size"): "gold_size",
}
# Sections and keys that say where files lie or which remote model answers; both are given to the operators by their callers.
ELSEWHERE = {"paths", "title", "embedding_model", "enabled", "provider", "model"}


def load_settings(path: str | Path | None = None, **overrides: object) -> Settings:
    """Settings from a YAML file, flat (our names) or nested in sections; unknown keys are an error."""
    values: dict = {}
    if path is not None:
        try:
            import yaml
        except ImportError as e:  # the YAML package is optional
            raise RuntimeError("reading a settings file needs PyYAML") from e
        for key, value in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items():
            if not isinstance(value, dict):
                values[key] = value
                continue
            for name, inner in value.items() if key not in ELSEWHERE else ():
                if (key, name) in NESTED:
                    values[NESTED[key, name]] = inner
                elif name not in ELSEWHERE:
                    values[f"{key}.{name}"] = inner  # unknown
    values |= overrides
    known = {f.name for f in dataclasses.fields(Settings)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
