"""Profiles: what a run reads, filters, splits, balances and trains, resolved from YAML and overrides.

Unknown keys are errors. Shares, limits and the seed may stand at the top level
or in a ``train:`` block; corpora may be listed as ``data.corpus_ids`` or as
``corpora``. With ``legacy=True`` the block and the list are ignored.
"""

from __future__ import annotations

import copy
import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields
from typing import Any

from .sources.dims import load_yaml

#: Names whose value may be given as a comma-separated list.
LISTS = {"families", "corpus_ids", "models_sklearn", "models_spacy", "models_hf"}
COMMON = ("corpora", "balance", "hardware", "models")


def _json(text: str) -> Any:
    return json.loads(text.replace("'", '"'))


def _list(text: str) -> list:
    try:
        return _json(text)
    except ValueError:
        parts = (p.strip().strip("\"'") for p in text[1:-1].split(","))
        return [cast(p) for p in parts if p]


_CASTS: list[Callable[[str], Any]] = [
    lambda s: {"true": True, "false": False, "none": None, "null": None}[s.lower()],
    int,
    float,
    lambda s: _list(s) if s[0] == "[" and s[-1] == "]" else int("x"),
    lambda s: _json(s) if s[0] == "{" and s[-1] == "}" else int("x"),
]


def cast(value: Any) -> Any:
    """A string as bool, null, int, float, list or dict if it looks like one."""
    text = value.strip() if isinstance(value, str) else ""
    for attempt in _CASTS if text else ():
        try:
            return attempt(text)
        except (KeyError, ValueError):
            continue
    return text or value


def override(settings: dict, given: Iterable[str]) -> dict:
    """Settings with ``a.b.c=value`` applied, inner mappings made as needed."""
    out = copy.deepcopy(settings)
    for item in given:
        path, sign, raw = item.partition("=")
        if not sign:
            raise ValueError(f"an override is key=value, not {item!r}")
        *outer, last = path.split(".")
        value = cast(raw)
        if last in LISTS and isinstance(value, str):
            value = [p.strip() for p in value.split(",") if p.strip()]
        at = out
        for key in outer:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at[last] = value
    return out


def seed_of(raw: Any, default: int | None = 42) -> int | None:
    """A seed as int; words for the clock give the time, what can't be read the default. Zero is a seed."""
    if isinstance(raw, str):
        raw = raw.strip().lower()
        if raw in {"time", "now", "auto", "random"}:
            return int(time.time())
    try:
        return int(raw)
    except (TypeError, ValueError):
        return default


@dataclass
class Corpus:
    corpus_id: str
    corpus_path: str = ""
    default_modality: str | None = None
    language: str | None = None
    notes: str = ""
    encoding: str = "utf-8"


@dataclass
class Profile:
    """A resolved profile; every field but the last group may stand in a profile file."""

    profile: str = ""
    description: str = ""
    view: str = ""
    corpus_id: str | None = None
    dataset_id: str | None = None
    eval_dataset_id: str | None = None
    modality: str | None = None
    label_field: str | None = None
    label_fields: list[str] = field(default_factory=list)
    label_map: str | None = None
    ideology: dict = field(default_factory=dict)
    actors: dict = field(default_factory=dict)
    normalize: dict = field(default_factory=dict)
    normalize_mode: str | None = None
    train_prop: float = 0.8
    dev_prop: float | None = None
    test_prop: float | None = None
    seed: int = 42
    min_chars: int = 0
    max_tokens: int | None = None
    tokenizer: str = "split"
    dedup_on: str = "none"
    max_docs_global: int = 0
    max_docs_global_mode: str = "head"
    balance_strategy: str = "none"
    balance_preset: str | None = None
    balance_mode: str | None = None
    families: list[str] = field(default_factory=lambda: ["check"])
    models_check: list[str] = field(default_factory=list)
    models_sklearn: list[str] = field(default_factory=list)
    models_spacy: list[str] = field(default_factory=list)
    models_hf: list[str] = field(default_factory=list)
    generate_spacy_docbin: bool = False
    spacy_max_chars: int = 0
    spacy_long_text_policy: str = "drop"
    spacy_docbin_from_tsv_fallback: bool = True
    hardware_preset: str = "small"
    debug_mode: bool = False
    max_train_docs_sklearn: int | None = None
    max_train_docs_spacy: int | None = None
    max_train_docs_hf: int | None = None
    data: dict = field(default_factory=dict)
    analysis: dict = field(default_factory=dict)
    pipeline_version: str | None = None
    corpora: list[Corpus] = field(default_factory=list)
    hardware: dict = field(default_factory=dict)
    preset: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    nested: list[str] = field(default_factory=list)

    @property
    def source_field(self) -> str:
        return self.data.get("source_field", "corpus_id")

    @property
    def text_mode(self) -> str:
        return self.normalize_mode or self.normalize.get("mode") or ("basic" if self.normalize else "none")

    @property
    def compare_by(self) -> list[str]:
        return list(self.analysis.get("compare_by") or [])

    def cap(self, family: str) -> int | None:
        """Documents a family trains on at most: its own setting, else the hardware's."""
        own = getattr(self, f"max_train_docs_{family}", None)
        return own if own is not None else self.hardware.get(f"max_train_docs_{family}")


_FILE_KEYS = {f.name for f in fields(Profile)} - {"hardware", "preset", "models", "nested"}
#: Accepted without effect, as in the files that exist.
_IGNORED = {"shard_docs", "shard_rows", "merge_mode"}


def find_preset(balance: dict, strategy: str, name: str | None) -> dict:
    """A strategy's own preset, else the shared one of that name, else nothing."""
    own = (((balance.get("strategies") or {}).get(strategy) or {}).get("presets") or {}).get(name)
    return own or (balance.get("presets") or {}).get(name) or {}


def resolve(profile: dict, common: dict[str, dict], overrides: Iterable[str] = (), legacy: bool = False) -> Profile:
    """A profile's mapping, the common mappings and overrides as one checked profile."""
    settings = dict(profile)
    block = settings.pop("train", None) or {}
    if not legacy:
        clash = sorted(k for k in block if k in settings and settings[k] != block[k])
        if clash:
            raise ValueError(f"{clash} stand both at the top and under train, with different values")
        settings = block | settings
    listed = settings.pop("corpora", None) or []
    settings = override(settings, overrides)
    unknown = sorted(set(settings) - _FILE_KEYS - _IGNORED)
    if unknown:
        raise ValueError(f"unknown keys in a profile: {unknown}")
    out = Profile(**{k: v for k, v in settings.items() if k in _FILE_KEYS and (v is not None or k in ("modality",))})
    out.nested = sorted(block)
    out.seed = seed_of(out.seed)
    known = common.get("corpora") or {}
    ids = list((out.data or {}).get("corpus_ids") or [])
    wanted = [] if legacy else [c["corpus_id"] if isinstance(c, dict) else c for c in listed]
    if ids and wanted and ids != wanted:
        raise ValueError(f"data.corpus_ids {ids} and corpora {wanted} differ")
    ids = ids or wanted
    several = bool(ids)
    ids = ids or ([out.corpus_id] if out.corpus_id else [])
    missing = [i for i in ids if i not in known]
    if missing or not ids:
        raise ValueError(f"corpora that aren't defined: {missing}" if missing else "a profile needs a corpus")
    names = {f.name for f in fields(Corpus)}
    out.corpora = [Corpus(**{"corpus_id": i} | {k: v for k, v in known[i].items() if k in names}) for i in ids]
    out.dataset_id = out.dataset_id or (out.profile if several else ids[0])
    if several:
        out.corpus_id = out.dataset_id
    mode = (out.balance_mode or "").strip().lower()
    if mode == "weights":
        out.balance_strategy = "class_weights"
    elif mode == "oversample" and "balance_strategy" not in settings:
        out.balance_strategy = "cap_docs"
    out.preset = dict(find_preset(common.get("balance") or {}, out.balance_strategy, out.balance_preset))
    out.hardware = dict(((common.get("hardware") or {}).get("presets") or {}).get(out.hardware_preset) or {})
    out.models = (common.get("models") or {}).get("families") or {}
    return out


def load(folder: str, name: str, overrides: Iterable[str] = (), legacy: bool = False) -> Profile:
    """``folder/profiles/name.yml`` with ``folder/common/*.yml``."""
    profile = load_yaml(os.path.join(folder, "profiles", f"{name}.yml"))
    common = {c: load_yaml(os.path.join(folder, "common", f"{c}.yml")) for c in COMMON}
    return resolve({"profile": name} | profile, common, overrides, legacy)
