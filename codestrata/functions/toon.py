"""A compact text form for JSON-like values, for results that are shown.

Objects are ``key: value`` lines, uniform lists of flat objects become one header with a row a line, lists of
scalars one line; strings are quoted only where they would read as something else.
"""

from __future__ import annotations

import json
import math
import re

NUMBER = re.compile(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
PLAIN_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")
SPECIAL = re.compile(r'[:"\\\[\]{},\x00-\x1f]')


def text(s: str) -> str:
    plain = s and s[0] not in " \t-#" and s[-1] not in " \t" and s not in ("true", "false", "null") and not NUMBER.match(s) and not SPECIAL.search(s)
    return s if plain else json.dumps(s, ensure_ascii=False)


def scalar(v: object) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if v == int(v) and abs(v) < 1e16:
            return str(int(v))
        short = repr(v)
        return short if "e" not in short else f"{v:.17f}".rstrip("0").rstrip(".")
    return text(str(v))


def key(k: str) -> str:
    return k if PLAIN_KEY.match(k) else json.dumps(k, ensure_ascii=False)


def _flat(v: object) -> bool:
    return not isinstance(v, (dict, list))


def _table(rows: list) -> list[str] | None:
    """The columns of rows that are non-empty flat objects with the same keys."""
    if not rows or not all(isinstance(r, dict) and r and all(map(_flat, r.values())) for r in rows):
        return None
    names = list(rows[0])
    return names if all(r.keys() == rows[0].keys() for r in rows) else None


def _list(head: str, rows: list, pad: str) -> list[str]:
    if all(map(_flat, rows)):
        return [f"{pad}{head}[{len(rows)}]:" + (" " + ",".join(map(scalar, rows)) if rows else "")]
    if names := _table(rows):
        out = [f"{pad}{head}[{len(rows)}]{{{','.join(map(key, names))}}}:"]
        return out + [pad + "  " + ",".join(scalar(r[n]) for n in names) for r in rows]
    out = [f"{pad}{head}[{len(rows)}]:"]
    for r in rows:
        if _flat(r):
            out.append(f"{pad}  - {scalar(r)}")
        else:
            inner = _object(r, pad + "    ") if isinstance(r, dict) else _list("", r, pad + "    ")
            out += [f"{pad}  - {inner[0].strip()}", *inner[1:]] if inner else [f"{pad}  -"]
    return out


def _object(v: dict, pad: str) -> list[str]:
    out = []
    for k, x in v.items():
        if isinstance(x, dict) and len(x) > 1 and (names := _table([*x.values()])):
            out.append(f"{pad}{key(k)}[{len(x)}:]{{{','.join(map(key, names))}}}:")
            out += [f"{pad}  {key(n)}: " + ",".join(scalar(r[c]) for c in names) for n, r in x.items()]
        elif isinstance(x, dict):
            out += [f"{pad}{key(k)}:", *_object(x, pad + "  ")]
        elif isinstance(x, list):
            out += _list(key(k), x, pad)
        else:
            out.append(f"{pad}{key(k)}: {scalar(x)}")
    return out


def encode(v: object) -> str:
    if isinstance(v, dict):
        return "\n".join(_object(v, ""))
    return "\n".join(_list("", v, "")) if isinstance(v, list) else scalar(v)


def fill_missing(rows: list[dict]) -> list[dict]:
    """Missing keys of flat rows as null, if the result is shorter."""
    if len(rows) < 2 or not all(r and all(map(_flat, r.values())) for r in rows):
        return rows
    names = list(dict.fromkeys(k for r in rows for k in r))
    full = [{n: r.get(n) for n in names} for r in rows]
    return full if len(encode(full)) < len(encode(rows)) else rows


def size(s: str) -> int:
    return len(s) + 3 * s.count("\n")


def auto(v: object) -> tuple[str, str]:
    """(format, text): whichever of JSON and this form costs less; JSON on a tie and for an empty object."""
    as_json, as_toon = json.dumps(v, ensure_ascii=False, separators=(",", ":")), encode(v)
    return ("toon", as_toon) if as_toon and size(as_toon) < size(as_json) else ("json", as_json)
