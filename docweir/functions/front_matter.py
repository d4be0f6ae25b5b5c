"""Front matter: split a leading YAML or TOML header off a document."""

from __future__ import annotations

import json
import tomllib

try:
    import yaml
except ImportError:  # the YAML form then stays part of the text
    yaml = None

PARSERS = {"---": yaml.safe_load if yaml else None, "+++": tomllib.loads}


def split_front_matter(text: str) -> tuple[str, str]:
    """``(meta as JSON, body)``; texts without a valid header come back unchanged."""
    bare = text.lstrip()
    mark = bare[:3]
    parse = PARSERS.get(mark)
    head, newline, rest = bare.partition("\n")
    block, closing, body = rest.partition("\n" + mark)
    if not (parse and newline and rest.strip() and closing):
        return "{}", text
    try:
        meta = parse(block) or {}
        return json.dumps(meta, default=str, ensure_ascii=False, sort_keys=True), body.lstrip("\n")
    except Exception:  # any parser error means: no front matter
        return "{}", text
