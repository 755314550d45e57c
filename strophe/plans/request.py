"""The declarative request: strict decoding, validation, and the ordered stages that it asks for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame

CHOICES = {
    "text_data": ("plain", "plain_edit", "usx", "csv", "script", "none"),
    "audio_data": ("files", "none"),
    "timestamps": ("tsv", "segments", "fragments", "tokens", "none"),
    "detail": ("lines", "words", "both"),
    "diacritics": ("", "remove", "nfc", "nfd", "nfkc", "nfkd"),
    "quotes": ("", "remove", "normalize"),
    "apostrophes": ("", "remove", "normalize"),
    "hyphens": ("", "remove", "normalize"),
}


class RequestError(ValueError):
    """Every problem of a request, one in a line."""


@dataclass(frozen=True)
class Compare:
    base_dataset: str = ""
    lower_case: bool = False
    remove_prompt_chars: bool = False
    remove_punctuation: bool = False
    quotes: str = ""
    apostrophes: str = ""
    hyphens: str = ""
    diacritics: str = ""
    filter_threshold: int = 0


@dataclass(frozen=True)
class Request:
    dataset_name: str = ""
    bible_id: str = ""
    is_new: bool = True
    text_data: str = "none"
    text_path: str = ""
    audio_data: str = "none"
    timestamps: str = "none"
    timestamps_path: str = ""
    detail: str = "lines"
    compare: Compare | None = None
    books: tuple[str, ...] = ()
    output_csv: str = ""
    output_json: str = ""
    language_iso: str = ""
    notify: tuple[str, ...] = field(default=())


def decode(data: dict[str, Any]) -> Request:
    """A request from parsed YAML or JSON; unknown keys and every other problem are reported together."""
    problems = [f"unknown field {k}" for k in data if k not in {f.name for f in fields(Request)}]
    compare = data.get("compare")
    if compare is not None:
        problems += [f"unknown field compare.{k}" for k in compare if k not in {f.name for f in fields(Compare)}]
    if problems:
        raise RequestError("\n".join(problems))
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()} | ({"compare": Compare(**compare)} if compare is not None else {})
    request = Request(**values)
    problems = validate(request)
    if problems:
        raise RequestError("\n".join(problems))
    bible = request.bible_id.upper()
    iso = request.language_iso or bible[:3].lower()
    detail = "both" if request.timestamps == "tokens" and request.detail == "lines" else request.detail
    return Request(**{f.name: getattr(request, f.name) for f in fields(Request)} | {"bible_id": bible, "language_iso": iso, "detail": detail})


def validate(r: Request) -> list[str]:
    found = [f"{n} is required" for n in ("dataset_name", "bible_id") if not getattr(r, n)]
    for name in ("text_data", "audio_data", "timestamps", "detail"):
        if getattr(r, name) not in CHOICES[name]:
            found.append(f"{name} must be one of {', '.join(CHOICES[name])}")
    if r.text_data != "none" and not r.text_path:
        found.append("text_path is required with text_data")
    if r.timestamps != "none" and not r.timestamps_path:
        found.append("timestamps_path is required with timestamps")
    if r.is_new and r.text_data == "none":
        found.append("a new dataset needs text_data")
    if r.compare is not None:
        if not r.compare.base_dataset:
            found.append("compare.base_dataset is required")
        found += [f"compare.{n} must be one of {', '.join(filter(None, CHOICES[n]))}" for n in ("quotes", "apostrophes", "hyphens", "diacritics") if getattr(r.compare, n) not in CHOICES[n]]
    return found


Tables = dict[str, DataFrame]
Stage = Callable[[Tables], Tables]


def run(stages: list[tuple[str, Stage]]) -> Tables:
    """Lazy tables after all stages; nothing is computed here."""
    tables: Tables = {}
    for _, stage in stages:
        tables = {**tables, **stage(tables)}
    return tables
