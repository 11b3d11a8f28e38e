"""Settings of a provider's client: kept as JSON, made again elsewhere; never its secrets or addresses."""

from __future__ import annotations

import json

ADDRESSES = {"base_url", "endpoint", "api_base", "api_url", "url"}
SECRETS = ("key", "token", "secret", "password", "credential")


_known: dict[tuple[str, str], type] = {}


def register(kind: type) -> type:
    """Lets ``restored`` make clients of this class: what a file names is never imported for its name alone."""
    _known[kind.__module__, kind.__name__] = kind
    return kind


def saved_settings(client) -> dict:
    """Plain public attributes of a client, with the class to make it again; the class counts as registered."""
    register(type(client))
    out = {"class_name": type(client).__name__, "module": type(client).__module__}
    for name in dir(client):
        if name.startswith("_") or any(a in name for a in ADDRESSES) or (any(s in name.lower() for s in SECRETS) and not name.startswith("max_")):
            continue
        value = getattr(client, name, None)
        if value is None or callable(value):
            continue
        try:
            json.dumps(value)
        except (TypeError, ValueError):
            continue
        out[name] = value
    return out


def restored(settings: dict):
    """A client of the saved class, if registered, with the saved settings; addresses and secrets come from its environment."""
    made = _known.get((settings["module"], settings["class_name"]))
    if made is None:
        raise ValueError(f"register {settings['module']}.{settings['class_name']} first")
    return made(**{k: v for k, v in settings.items() if k not in ("class_name", "module")})
