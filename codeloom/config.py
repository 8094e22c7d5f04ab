"""Settings of a run, with the checks that each entry point asks for."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Fixed value: the pattern of the shipped template, from the first fence to the last.
FENCE = r"(?s)\x60\x60\x60(?:(?:javascript|java|cpp|csharp|python|script|rust|c|go|C\+\+|Javascript|JavaScript|Java|Python|C#|C|Rust|Script|Go))?(.+)\x60\x60\x60"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class EngineConfig:
    """What a translation run needs to know; names in files may be camel case, as ``KEYS`` lists them."""

    depth: int = 3
    early_stop: str = "direct"  #: "direct", "any" or "never"
    verify_intermediates: bool = False
    regex_inference_only: bool = True
    transcoder_format: bool = False
    use_inference_cache: bool = False
    use_response_cache: bool = False
    use_execution_cache: bool = True
    cache_failures: bool = True
    cache_path: str = ""
    max_tokens: int = 4096
    temperature: float = 0.7
    top_p: float = 0.95
    top_k: int = 10
    seed: int = -1
    backend: str = "vllm"
    attempts: int = 10
    prompt_templates: Mapping[str, str] = field(default_factory=dict)
    regex_templates: Mapping[str, str] = field(default_factory=lambda: {"temperature": FENCE})
    verification_template: str = "temperature"
    endpoints: tuple[str, ...] = ()
    token: str = ""
    containers: Mapping[str, str] = field(default_factory=dict)
    inference_workers: int = 2
    execution_workers: int = 4

    def __post_init__(self):
        if self.depth < 1:
            raise ConfigError("depth starts at 1")
        if self.early_stop not in ("direct", "any", "never"):
            raise ConfigError(f"early_stop: {self.early_stop}")
        for name, pattern in self.regex_templates.items():
            if group_count(pattern) < 1:
                raise ConfigError(f"regex template {name} has no group")

    def regex(self, name: str) -> str:
        if name not in self.regex_templates:
            raise ConfigError(f"no regex template {name}")
        return self.regex_templates[name]

    def check_attempts(self) -> None:
        """What independent attempts at a direct translation ask for."""
        if self.depth != 1:
            raise ConfigError("attempts are direct translations: depth has to be 1")
        if self.seed != -1:
            raise ConfigError("attempts with a fixed seed would all be alike")
        if self.use_inference_cache:
            raise ConfigError("attempts must not come from the inference cache")

    def check_verification(self) -> None:
        if not self.regex_inference_only:
            raise ConfigError("verification extracts from the inference output alone")

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)


#: The names of settings in configuration files.
KEYS = {
    "expansionIntermediaryNodes": "depth",
    "earlyStop": "early_stop",
    "verifyIntermediateTranslations": "verify_intermediates",
    "applyRegexInferenceOnly": "regex_inference_only",
    "useTranscoderTestFormat": "transcoder_format",
    "useInferenceCache": "use_inference_cache",
    "useResponseCache": "use_response_cache",
    "useExecutionCache": "use_execution_cache",
    "cacheDatabasePath": "cache_path",
    "maxGeneratedTokens": "max_tokens",
    "temperature": "temperature",
    "top-p": "top_p",
    "top-k": "top_k",
    "inferenceSeed": "seed",
    "inferenceBackend": "backend",
    "promptTemplates": "prompt_templates",
    "regexTemplates": "regex_templates",
    "inferenceApiBaseUrls": "endpoints",
    "inferenceApiToken": "token",
    "executionContainers": "containers",
    "numInferenceWorkers": "inference_workers",
    "numExecutionWorkers": "execution_workers",
}


def group_count(pattern: str) -> int:
    """Capturing groups of a pattern; one that cannot be read raises ConfigError."""
    try:
        return re.compile(pattern).groups
    except re.error as e:
        raise ConfigError(f"pattern {pattern!r}: {e}") from e


def from_mapping(values: Mapping) -> EngineConfig:
    """A configuration from file keys or field names; keys that the engine never reads are ignored."""
    known = {f.name for f in fields(EngineConfig)}
    out = {}
    for k, v in values.items():
        name = KEYS.get(k, k)
        if name in known:
            out[name] = v
    if isinstance(out.get("early_stop"), bool):
        out["early_stop"] = "direct" if out["early_stop"] else "never"
    if "endpoints" in out:
        out["endpoints"] = tuple(out["endpoints"])
    return EngineConfig(**out)


def load(path: str) -> EngineConfig:
    """A configuration from a JSON or, where a YAML reader is installed, a YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_mapping(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs PyYAML; JSON works without") from e
    return from_mapping(yaml.safe_load(text))
