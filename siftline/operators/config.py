"""Parameters of audits and selections."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


# Defaults of thresholds, weights and run sizes.
@dataclass
class AuditConfig:
    tau_l: float = 0.15
    tau_c: float = 0.60
    tau_h: float = 0.70
    alpha_u: float = 1.0
    alpha_c: float = 0.75
    alpha_d: float = 0.5
    alpha_l: float = 1.0
    alpha_h: float = 0.75
    ngram_n: int = 10
    shingle_n: int = 5
    embedding_threshold: float = 0.85
    embedder: str = "hash"
    embedding_dim: int = 768
    neighbor_k: int = 5

    @property
    def relaxed_tau_c(self) -> float:
        return min(self.tau_c, 0.45)


@dataclass
class GenerationConfig:
    backend: str = "heuristic"
    model: str = ""
    endpoint_url: str | None = None
    api_key_env: str | None = None
    temperature: float = 0.8
    top_p: float = 0.95
    max_new_tokens: int = 256
    candidates_per_seed: int = 1
    request_timeout: int = 180
    request_retries: int = 3


@dataclass
class JudgeConfig:
    backend: str = "disabled"
    model: str = ""
    endpoint_url: str | None = None
    api_key_env: str | None = None
    temperature: float = 0.0
    max_tokens: int = 512
    request_timeout: int = 180
    request_retries: int = 3


@dataclass
class RunConfig:
    manifest_path: str = "data/manifest"
    output_dir: str = "runs"
    datasets: list[str] = field(default_factory=list)
    tasks: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    budgets: list[int] = field(default_factory=lambda: [64])
    multipliers: list[int] = field(default_factory=lambda: [3])
    seeds: list[int] = field(default_factory=lambda: [13])
    baselines: list[str] = field(default_factory=lambda: ["audited"])
    selection_multiplier: int | None = None
    sample_per_class_when_possible: bool = False
    seed_sampling: str | None = None
    max_per_source: int = 3
    audit: AuditConfig = field(default_factory=AuditConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    judge: JudgeConfig = field(default_factory=JudgeConfig)


SECTIONS = {"audit": AuditConfig, "generation": GenerationConfig, "judge": JudgeConfig}
#: Other names of parameters in configuration files.
ALIASES = {"minhash_n": "shingle_n", "embedding_leakage_threshold": "embedding_threshold"}


def from_mapping(kind: type, given: dict):
    """A configuration from a mapping; unknown keys are left out, and sections are read likewise."""
    known = {f.name for f in fields(kind)}
    kept = {ALIASES.get(k, k): v for k, v in given.items() if ALIASES.get(k, k) in known}
    for name, section in SECTIONS.items():
        if isinstance(kept.get(name), dict):
            kept[name] = from_mapping(section, kept[name])
    return kind(**kept)


def parse_yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("configuration files need the yaml package") from e
    return yaml.safe_load(text) or {}


def load_config(text: str) -> RunConfig:
    return from_mapping(RunConfig, parse_yaml(text))


def flag(value: str | None) -> bool:
    """Whether an environment's value switches something on."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")
