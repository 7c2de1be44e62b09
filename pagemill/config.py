"""Settings of a crawl: defaults, a JSON file, and what the operators take from them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace
from urllib.parse import urlsplit

from .functions.hashing import ALGORITHMS
from .operators.extract import ExtractParams
from .plans.crawl import CrawlParams

_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}


class BadConfig(ValueError):
    pass


def duration_ms(text: str) -> float:
    """Milliseconds of a duration such as "1m30s" or "500ms"."""
    sign, rest = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    if rest == "0":
        return 0.0
    found = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", rest)
    if not found or "".join(n + u for n, u in found) != rest:
        raise BadConfig(f"no duration: {text!r}")
    return sign * sum(float(n) * _UNITS[u] for n, u in found)


@dataclass(frozen=True)
class Config:
    seed_urls: tuple[str, ...] = ()
    allowed_hosts: frozenset[str] = frozenset()
    allowed_path_prefix: tuple[str, ...] = ("/",)
    max_depth: int = 3
    max_pages: int = 100
    concurrency: int = 10
    base_delay: float = 1000.0  # durations are milliseconds
    jitter: float = 500.0
    random_seed: int = 0
    max_attempt: int = 10
    backoff_initial_duration: float = 100.0
    backoff_multiplier: float = 2.0
    backoff_max_duration: float = 10_000.0
    timeout: float = 10_000.0
    max_idle_conns: int = 10
    max_idle_conns_per_host: int = 3
    idle_conn_timeout: float = 30_000.0
    user_agent: str = "pagemill/1.0"
    max_asset_size: int = 0
    output_dir: str = "output"
    dry_run: bool = False
    dump_stage_output: str = ""
    body_specificity_bias: float = 0.75
    link_density_threshold: float = 0.8
    score_multiplier_non_whitespace_divisor: float = 50.0
    score_multiplier_paragraphs: float = 5.0
    score_multiplier_headings: float = 10.0
    score_multiplier_code_blocks: float = 15.0
    score_multiplier_list_items: float = 2.0
    threshold_min_non_whitespace: int = 50
    threshold_min_headings: int = 0
    threshold_min_paragraphs_or_code: int = 1
    threshold_max_link_density: float = 0.8
    hash_algo: str = "sha256"
    selector_blacklist: tuple[str, ...] = ()
    debug: bool = False
    debug_file: str = ""
    debug_format: str = ""
    selectors: tuple[str, ...] = field(default=())

    def built(self) -> Config:
        """Checked, and with the seeds' hosts where none were named."""
        if not self.seed_urls:
            raise BadConfig("there must be a seed URL")
        if self.hash_algo not in ALGORITHMS:
            raise BadConfig(f"unknown hash algorithm {self.hash_algo!r}")
        hosts = frozenset(h for u in self.seed_urls if (h := urlsplit(u).netloc.rsplit("@", 1)[-1]))
        return self if self.allowed_hosts else replace(self, allowed_hosts=hosts)

    def crawl_params(self) -> CrawlParams:
        return CrawlParams(max_depth=self.max_depth, max_pages=self.max_pages)

    def extract_params(self) -> ExtractParams:
        return ExtractParams(
            body_bias=self.body_specificity_bias, link_density=self.link_density_threshold, per_text=self.score_multiplier_non_whitespace_divisor, per_paragraph=self.score_multiplier_paragraphs,
            per_heading=self.score_multiplier_headings, per_code=self.score_multiplier_code_blocks, per_item=self.score_multiplier_list_items, min_text=self.threshold_min_non_whitespace,
            min_headings=self.threshold_min_headings, min_blocks=self.threshold_min_paragraphs_or_code, max_link_density=self.threshold_max_link_density, selectors=self.selectors, blacklist=self.selector_blacklist,
        )


_DURATIONS = ("base_delay", "jitter", "backoff_initial_duration", "backoff_max_duration", "timeout", "idle_conn_timeout")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def from_json(text: str) -> Config:
    """Settings of a JSON object: absent ones keep their defaults, but for the path prefixes, of which there are then none."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise BadConfig(f"no JSON: {e}") from e
    if not isinstance(raw, dict):
        raise BadConfig("no JSON object")
    given = {k.lower(): v for k, v in raw.items()}
    made: dict = {"allowed_path_prefix": ()}
    for f in fields(Config):
        value = given.get("seedurls" if f.name == "seed_urls" else _camel(f.name).lower())
        if value is None:
            continue
        if f.name in _DURATIONS:
            if not isinstance(value, str):
                raise BadConfig(f"{f.name}: a duration is a string such as 2s")
            made[f.name] = duration_ms(value)
        elif isinstance(f.default, tuple | frozenset):
            if not isinstance(value, dict | list) or not all(isinstance(x, str) for x in value):
                raise BadConfig(f"{f.name}: strings are expected")
            made[f.name] = frozenset(value) if isinstance(f.default, frozenset) else tuple(value)
        elif isinstance(f.default, float) and isinstance(value, int) and not isinstance(value, bool):
            made[f.name] = float(value)
        elif type(value) is not type(f.default):
            raise BadConfig(f"{f.name}: {value!r} is of the wrong kind")
        else:
            made[f.name] = value
    if not made.get("allowed_hosts", True):
        del made["allowed_hosts"]
    return Config(**made)


def load(path: str, **overrides: object) -> Config:
    """The settings of a file, with some replaced, checked."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise BadConfig(f"{path} can't be read: {e}") from e
    return replace(from_json(text), **overrides).built()
