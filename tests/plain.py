import json


def canonical(value):
    """Canonical JSON written by the standard library."""
    return json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode(value)
