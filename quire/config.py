"""Options with their defaults, read from lenient JSON and checked before planning."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from quire import dims


class ConfigError(ValueError):
    """An option is out of its range."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Generation:
    max_tokens: int = 4096
    temperature: float = 0.8
    prefill_step: int = 2048
    top_p: float = 0.9
    top_k: int = 50
    repetition_penalty: float = 1.1
    repetition_window: int = 20

    def check(self) -> None:
        _need(self.max_tokens > 0, "max_tokens must be positive")
        _need(self.temperature >= 0, "temperature must not be negative")
        _need(self.prefill_step > 0, "prefill_step must be positive")
        _need(0 <= self.top_p <= 1, "top_p must lie in 0 to 1")
        _need(self.top_k >= 0, "top_k must not be negative")
        _need(self.repetition_penalty > 0, "repetition_penalty must be positive")


@dataclass(frozen=True)
class Layout:
    threshold: float = 0.3
    class_thresholds: dict[str, float] = field(default_factory=dict)  # by label or class id
    nms: bool = True
    same_class_iou: float = 0.6
    cross_class_iou: float = 0.98
    containment: float = 0.8
    large_image_landscape: float = 0.82
    large_image_other: float = 0.93
    unclip: tuple[float, float] = (1.0, 1.0)
    merge_modes: dict[str, str] = field(default_factory=dict)  # by label: union, large or small

    def check(self) -> None:
        _need(0 <= self.threshold <= 1, "threshold must lie in 0 to 1")
        _need(all(0 <= t <= 1 for t in self.class_thresholds.values()), "class thresholds must lie in 0 to 1")
        _need(all(k in dims.CLASSES or k.isdigit() for k in self.class_thresholds), "class_thresholds names an unknown class")
        _need(all(u > 0 for u in self.unclip), "unclip ratios must be positive")
        _need(all(m in ("union", "large", "small") for m in self.merge_modes.values()), "merge_modes holds an unknown mode")

    def threshold_of(self, cls: int) -> float:
        return self.class_thresholds.get(dims.CLASSES[cls], self.class_thresholds.get(str(cls), self.threshold))

    @property
    def pre_threshold(self) -> float:
        return min([self.threshold, *self.class_thresholds.values()])


@dataclass(frozen=True)
class Prompts:
    page: str = dims.PAGE_PROMPT
    text: str = dims.PROMPTS["text"]
    table: str = dims.PROMPTS["table"]
    formula: str = dims.PROMPTS["formula"]

    def check(self) -> None:
        for f in fields(self):
            _need(bool(getattr(self, f.name).strip()), f"the {f.name} prompt is empty")


@dataclass(frozen=True)
class Performance:
    batch_size: int = 4
    batch_max_wait_ms: int = 8
    max_inflight: int = 64
    render_concurrency: int = 2
    preprocess_concurrency: int = 4
    encode_concurrency: int = 2

    def check(self) -> None:
        for f in fields(self):
            _need(getattr(self, f.name) > 0, f"{f.name} must be positive")


@dataclass(frozen=True)
class Bundle:
    enabled: bool = False
    markdown_name: str = "document.md"
    sidecar_name: str = "document.json"
    figures_dir: str = "figures"
    figure_format: str = "heic"
    figure_naming: str = "page_region_padded"
    quality: float = 0.82

    def check(self) -> None:
        for name in (self.markdown_name, self.sidecar_name, self.figures_dir):
            _need(bool(name.strip()) and "/" not in name and "\\" not in name and name not in (".", ".."), f"not a name of a file: {name!r}")
        _need(self.figure_format in ("heic", "jpeg", "png"), "figure_format is heic, jpeg or png")
        _need(self.figure_naming in ("page_region_padded", "upstream_cropped"), "unknown figure_naming")
        _need(0 <= self.quality <= 1, "quality must lie in 0 to 1")


@dataclass(frozen=True)
class Config:
    enable_layout: bool = True
    max_concurrent_recognitions: int = 1
    default_max_pages: int | None = None
    pdf_dpi: int = 200
    pdf_max_long_side: int = 3500
    generation: Generation = field(default_factory=Generation)
    layout: Layout = field(default_factory=Layout)
    prompts: Prompts = field(default_factory=Prompts)
    performance: Performance = field(default_factory=Performance)
    bundle: Bundle = field(default_factory=Bundle)

    def check(self) -> "Config":
        _need(self.max_concurrent_recognitions > 0, "max_concurrent_recognitions must be positive")
        _need(self.default_max_pages is None or self.default_max_pages > 0, "default_max_pages must be positive")
        _need(self.pdf_dpi > 0 and self.pdf_max_long_side > 0, "raster sizes must be positive")
        for part in (self.generation, self.layout, self.prompts, self.performance, self.bundle):
            part.check()
        return self

    @property
    def inflight(self) -> int:
        """Recognitions in flight: the older option where only it was set, else the newer ones."""
        return self.max_concurrent_recognitions if self.performance == Performance() else self.performance.max_inflight

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Config":
        """Every key is optional; unknown ones are ignored."""
        return _read(cls, json.loads(text)).check()


@dataclass(frozen=True)
class ParseOptions:
    include_markdown: bool = True
    include_diagnostics: bool = True
    max_pages: int | None = None

    def check(self) -> "ParseOptions":
        _need(self.max_pages is None or self.max_pages > 0, "max_pages must be positive")
        return self


def _pair(value: Any) -> tuple[float, float]:
    """A ratio given as a list, one number, or an object of x and y or width and height."""
    if isinstance(value, (int, float)):
        return float(value), float(value)
    if isinstance(value, dict):
        return float(value.get("x", value.get("width"))), float(value.get("y", value.get("height")))
    return float(value[0]), float(value[1])


def _read(kind: type, data: dict) -> Any:
    base, out = kind(), {}
    for f in fields(kind):
        if data.get(f.name) is None:
            continue
        old, new = getattr(base, f.name), data[f.name]
        if hasattr(old, "check"):
            out[f.name] = _read(type(old), new)
        elif f.name == "unclip":
            out[f.name] = _pair(new)
        else:
            out[f.name] = new
    return replace(base, **out)
