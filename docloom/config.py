"""Settings: a commented JSON file, over defaults, under the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Mapping

_PART = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
_TRAIL = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])', re.S)


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; neither counts inside strings."""
    keep = lambda m: m[0] if m[0].startswith('"') else ""
    return json.loads(_TRAIL.sub(keep, _PART.sub(keep, text)) or "{}")


def coerced(raw: object, like: object) -> object:
    """A value in the type of its default: truth words, numbers, comma lists; what does not fit is an error."""
    if isinstance(like, bool):
        return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)) and not isinstance(raw, (int, float)):
        return type(like)(str(raw).strip())
    if isinstance(like, (list, tuple)):
        return type(like)(raw if isinstance(raw, (list, tuple)) else [x.strip() for x in str(raw).split(",") if x.strip()])
    return type(like)(raw) if isinstance(like, (int, float)) else raw if like is None else str(raw)


@dataclasses.dataclass(frozen=True)
class Ocr:
    min_text_chars: int = 100
    min_page_chars: int = 50
    sparse_page_ratio: float = 0.3
    max_total_chars: int = 6000
    langs: str = "heb+eng"


@dataclasses.dataclass(frozen=True)
class Watch:
    settle: float = 2.0
    polling: float = 5.0
    debounce: float = 5.0


@dataclasses.dataclass(frozen=True)
class Settings:
    docs: str = "."
    inbox: str = "Inbox"
    ocr: Ocr = Ocr()
    watch: Watch = Watch()


def settings(text: str = "", env: Mapping[str, str] | None = None, prefix: str = "DOCLOOM_") -> Settings:
    """The environment (PREFIX_FIELD, PREFIX_SECTION_FIELD) over the file over the defaults; unknown keys are left out."""
    env = os.environ if env is None else env
    given = parse_jsonc(text)

    def layered(default, own: dict, name: str):
        made = {}
        for field in dataclasses.fields(default):
            was = getattr(default, field.name)
            key = f"{name}{field.name.upper()}"
            if dataclasses.is_dataclass(was):
                part = own.get(field.name)
                made[field.name] = layered(was, part if isinstance(part, dict) else {}, key + "_")
            elif key in env:
                made[field.name] = coerced(env[key], was)
            elif own.get(field.name) is not None:
                made[field.name] = coerced(own[field.name], was)
        return dataclasses.replace(default, **made)

    return layered(Settings(), given, prefix)
