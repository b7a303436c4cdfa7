"""Settings of a run: defaults, what they may be, and what is wrong with those given.

The rules are data, so that one set of them checks a file on the driver and a
table of many runs' settings (recording or run, key, value) as a query.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions.text import is_local_endpoint, unknown_fields  # noqa: F401


class ConfigError(ValueError):
    """Settings that can't be used."""


# Providers, what a model may be able to do, tasks, and how hard a model may think.
PROVIDERS = ("openai_chat", "openai_responses", "anthropic_messages", "openai_compatible_chat")
CAPABILITIES = ("vision", "prompt_cache", "json_mode", "streaming", "reasoning")
TASKS = ("segment", "refine", "outline", "section", "slide_judge", "slide_describe")
EFFORTS = ("minimal", "low", "medium", "high")
TIME_FIELDS = ("hms", "mmss", "seconds", "seconds_int")
URL_FIELDS = ("seconds", "seconds_int", "source_path", "source_filename", "hms")
# Each setting with its default and what it may be: one of some values, a number above or from a bound, or text.
SETTINGS: dict[str, tuple[Any, tuple]] = {
    "project.cache_dir": ("./cache", ("text",)),
    "project.output_dir": ("./output", ("text",)),
    "asr.backend": ("faster_whisper_local", ("text",)),
    "asr.model": ("large-v3", ("text",)),
    "asr.device": ("auto", ("text",)),
    "asr.compute_type": ("auto", ("text",)),
    "asr.use_batched": (True, ("flag",)),
    "asr.batch_size": (16, ("whole",)),
    "asr.vad": (True, ("flag",)),
    "asr.language": ("zh", ("text",)),
    "audio_pipeline.extract.sample_rate": (16000, ("one", 8000, 16000, 22050, 32000, 44100, 48000)),
    "audio_pipeline.extract.channels": (1, ("one", 1, 2)),
    "audio_pipeline.refine.mode": ("adaptive", ("one", "adaptive", "single_call", "batched", "serial")),
    "audio_pipeline.refine.batch_size": (8, ("above", 0)),
    "visual_pipeline.filter.detector": ("content", ("one", "content")),
    "visual_pipeline.filter.threshold": ("auto", ("auto_or_above", 0)),
    "visual_pipeline.filter.auto_threshold_candidates": ((10.0, 15.0, 20.0, 25.0, 27.0, 30.0, 35.0, 40.0), ("all_above", 0)),
    "visual_pipeline.filter.target_frames_per_minute": (1.5, ("above", 0)),
    "visual_pipeline.filter.min_scene_len_seconds": (1.0, ("above", 0)),
    "visual_pipeline.filter.representative": ("content", ("one", "content", "last", "middle")),
    "visual_pipeline.filter.candidate_fps": (3.0, ("above", 0)),
    "visual_pipeline.filter.min_content_score": (0.5, ("above", 0)),
    "visual_pipeline.filter.duplicate_pixel_mean_threshold": (0.025, ("above", 0)),
    "visual_pipeline.describe.concurrent_calls": (5, ("above", 0)),
    "visual_pipeline.align.max_context_gap_seconds": (3.0, ("from", 0)),
    "merge.outline.target_chapter_count_hint": ("5-12", ("text",)),
    "merge.section.concurrent_calls": (5, ("above", 0)),
    "merge.assemble.timestamp_format": ("[{hms}]", ("fields", *TIME_FIELDS)),
    "merge.assemble.include_toc": (True, ("flag",)),
    "merge.assemble.include_metadata": (True, ("flag",)),
    "merge.assemble.video_url_template": (None, ("fields", *URL_FIELDS)),
    "merge.assemble.top_title": (None, ("text",)),
}

#: Settings of how many requests of a task run side by side.
CONCURRENT = {"slide_describe": "visual_pipeline.describe.concurrent_calls", "section": "merge.section.concurrent_calls"}


# ---------------------------------------------------------------- as a query


def _breaks(value: Column, rule: tuple) -> Column:
    kind, *args = rule
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    if kind == "one":
        return ~value.isin(*map(str, args))
    if kind == "flag":
        return ~F.lower(value).isin("true", "false")
    if kind == "whole":
        return value.try_cast("int").isNull()
    if kind == "above":
        return ~(finite & (number > args[0]))
    if kind == "from":
        return ~(finite & (number >= args[0]))
    if kind == "auto_or_above":
        return ~((value == "auto") | (finite & (number > args[0])))
    if kind == "all_above":
        items = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("double"))
        return ~F.forall(items, lambda x: F.coalesce((x > args[0]) & ~F.isnan(x) & (x < float("inf")), F.lit(False)))
    if kind == "fields":
        return F.size(unknown_fields(value, tuple(args))) > 0
    return F.lit(False)


def setting_violations(settings: DataFrame) -> DataFrame:
    """settings (run_id, key, value as text) -> (run_id, key, rule): unknown_key, or the kind of rule that the value breaks.

    A null value takes the default and breaks nothing.
    """
    rule = F.when(~F.col("key").isin(*SETTINGS), "unknown_key")
    for key, (_, limits) in SETTINGS.items():
        if limits[0] != "text":
            rule = rule.when((F.col("key") == key) & _breaks(F.col("value"), limits), limits[0])
    return settings.where("value is not null").select("run_id", "key", rule.alias("rule")).where("rule is not null")


def profile_violations(profiles: DataFrame) -> DataFrame:
    """profiles (profile, provider, capabilities array, reasoning_effort, thinking_budget_tokens, rpm_limit, tpm_limit) -> (profile, rule).

    The rules a profile breaks, of: provider, capabilities, effort, budget,
    limits, reasoning (options without the capability) and options (those of the
    other kind of provider).
    """
    effort, budget = F.col("reasoning_effort"), F.col("thinking_budget_tokens")
    asked = effort.isNotNull() | budget.isNotNull()
    rules = {
        "provider": ~F.col("provider").isin(*PROVIDERS),
        "capabilities": F.size(F.array_except("capabilities", F.array(*map(F.lit, CAPABILITIES)))) > 0,
        "effort": ~effort.isin(*EFFORTS),
        "budget": budget <= 0,
        "limits": (F.col("rpm_limit") <= 0) | (F.col("tpm_limit") <= 0),
        "reasoning": asked & ~F.array_contains("capabilities", "reasoning"),
        "options": ((F.col("provider") == "anthropic_messages") & effort.isNotNull()) | (F.col("provider").isin("openai_chat", "openai_responses", "openai_compatible_chat") & budget.isNotNull()),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return profiles.select("profile", F.explode(broken).alias("rule"))


def task_violations(tasks: DataFrame, profiles: DataFrame) -> DataFrame:
    """tasks (run_id, task, profile) -> (run_id, task, rule): unknown_task, unknown_profile, or missing for one that has none."""
    known = profiles.select("profile", F.lit(True).alias("known")).distinct()
    given = tasks.join(known, "profile", "left").select("run_id", "task", F.when(~F.col("task").isin(*TASKS), "unknown_task").when(F.col("known").isNull(), "unknown_profile").alias("rule"))
    wanted = tasks.select("run_id").distinct().withColumn("task", F.explode(F.array(*map(F.lit, TASKS))))
    missing = wanted.join(tasks.select("run_id", "task"), ["run_id", "task"], "left_anti").withColumn("rule", F.lit("missing"))
    return given.where("rule is not null").unionByName(missing)


# ---------------------------------------------------------------- one run, on the driver


@dataclass(frozen=True)
class Options:
    """What one request asks for; what it leaves open comes from its profile."""

    temperature: float | None = None
    max_output_tokens: int | None = None
    json_mode: bool = False
    reasoning_effort: str | None = None
    thinking_budget_tokens: int | None = None
    timeout_seconds: float | None = None


@dataclass(frozen=True)
class Profile:
    name: str
    provider: str
    model: str = ""
    base_url: str | None = None
    api_key_env: str | None = None
    capabilities: frozenset[str] = frozenset()
    max_context: int | None = None
    timeout_seconds: float | None = None
    reasoning_effort: str | None = None
    thinking_budget_tokens: int | None = None
    rpm_limit: int | None = None
    tpm_limit: int | None = None

    def options(self, asked: Options) -> Options:
        own = lambda a, b: b if a is None else a
        return replace(asked, **{name: own(getattr(asked, name), getattr(self, name)) for name in ("reasoning_effort", "thinking_budget_tokens", "timeout_seconds")})

    def refuses(self, asked: Options, *, images: bool = False) -> str | None:
        """Why this profile can't take a request, or None."""
        can, effort, budget = self.capabilities, asked.reasoning_effort, asked.thinking_budget_tokens
        if asked.json_mode and "json_mode" not in can:
            return "no json_mode"
        if effort is not None and effort not in EFFORTS:
            return "unknown reasoning effort"
        if budget is not None and budget <= 0:
            return "thinking budget must be positive"
        if (effort is not None or budget is not None) and "reasoning" not in can:
            return "no reasoning"
        if effort is not None and self.provider == "anthropic_messages":
            return "takes a thinking budget, no reasoning effort"
        if budget is not None and self.provider != "anthropic_messages":
            return "takes a reasoning effort, no thinking budget"
        if budget is not None and asked.max_output_tokens is not None and budget >= asked.max_output_tokens:
            return "thinking budget must be under the output limit"
        return "no vision" if images and "vision" not in can else None

    def key(self, environment: dict[str, str] | None = None) -> str | None:
        """The service's key; a compatible service on this machine may do without."""
        if self.api_key_env is None:
            if self.provider == "openai_compatible_chat" and is_local(self.base_url):
                return None
            raise ConfigError(f"profile {self.name} names no variable for its key")
        value = (os.environ if environment is None else environment).get(self.api_key_env)
        if not value:
            raise ConfigError(f"profile {self.name} needs the variable {self.api_key_env}")
        return value


def is_local(url: str | None) -> bool:
    from urllib.parse import urlparse

    return url is not None and urlparse(url).hostname in ("localhost", "127.0.0.1", "::1")


@dataclass(frozen=True)
class Config:
    profiles: dict[str, Profile]
    tasks: dict[str, str]
    settings: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return self.settings.get(key, SETTINGS[key][0])

    def calls(self, task: str) -> dict[str, int]:
        """How a model stage's requests run side by side, for ``clients.complete_rows``: one task with so many requests under way."""
        return {"tasks": 1, "at_once": int(self[CONCURRENT[task]])} if task in CONCURRENT else {}

    def profile_of(self, task: str) -> Profile:
        if task not in self.tasks:
            raise ConfigError(f"no such task: {task}")
        return self.profiles[self.tasks[task]]


def _flat(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in tree.items():
        out |= _flat(value, f"{prefix}{key}.") if isinstance(value, dict) else {prefix + key: value}
    return out


def _broken(value: Any, rule: tuple) -> bool:
    """The rules of ``_breaks`` for one value of a file."""
    import math
    import string

    kind, *args = rule
    numeric = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    checks = {
        "text": lambda: not isinstance(value, str), "flag": lambda: not isinstance(value, bool), "one": lambda: value not in args,
        "whole": lambda: not isinstance(value, int) or isinstance(value, bool), "above": lambda: not (numeric(value) and value > args[0]), "from": lambda: not (numeric(value) and value >= args[0]),
        "auto_or_above": lambda: value != "auto" and not (numeric(value) and value > args[0]),
        "all_above": lambda: not isinstance(value, list | tuple) or not value or not all(numeric(x) and x > args[0] for x in value),
        "fields": lambda: not isinstance(value, str) or bool({f for _, f, _, _ in string.Formatter().parse(value) if f} - set(args)),
    }
    return checks[kind]()


def make_config(tree: dict) -> Config:
    """Settings from a tree of them; raises ConfigError with all that is wrong."""
    tree = dict(tree)
    profiles, tasks, wrong = (tree.pop("llm", None) or {}).get("profiles") or {}, tree.pop("tasks", None) or {}, []
    settings = {k: v for k, v in _flat(tree).items() if v is not None}
    for key, value in settings.items():
        if key not in SETTINGS:
            wrong.append(f"unknown setting {key}")
        elif _broken(value, SETTINGS[key][1]):
            wrong.append(f"{key} can't be {value!r}")
    made = {}
    for name, given in profiles.items():
        try:
            p = made[name] = Profile(**(dict(given) | {"name": name, "capabilities": frozenset(given.get("capabilities") or ())}))
        except TypeError as e:
            wrong.append(f"profile {name}: {e}")
            continue
        if p.provider not in PROVIDERS or p.capabilities - set(CAPABILITIES):
            wrong.append(f"profile {name}: unknown provider or capability")
        if any(x is not None and x <= 0 for x in (p.rpm_limit, p.tpm_limit)):
            wrong.append(f"profile {name}: limits must be positive")
        if why := p.refuses(p.options(Options())):
            wrong.append(f"profile {name}: {why}")
    wrong += [f"unknown task {t}" for t in tasks if t not in TASKS] + [f"task {t} has no profile" for t in TASKS if t not in tasks]
    wrong += [f"task {t} names unknown profile {p}" for t, p in tasks.items() if p not in profiles]
    if wrong:
        raise ConfigError("; ".join(wrong))
    return Config(made, dict(tasks), settings)


def load_config(path: str) -> Config:
    """Settings from a JSON file, or a YAML file where a reader for it is installed."""
    if not Path(path).exists():
        raise ConfigError(f"no such file: {path}")
    text = Path(path).read_text(encoding="utf-8")
    try:
        return make_config(json.loads(text) or {})
    except json.JSONDecodeError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ConfigError(f"{path} is no JSON, and no reader for YAML is installed") from e
    return make_config(yaml.safe_load(text) or {})
