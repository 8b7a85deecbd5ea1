"""JSON texts as values and back, without recursion and with numbers spelled as they were."""

import json
import re

_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.S)
_NAMED = {"true": True, "false": False, "null": None}


class Number(str):
    """A number's text."""


class Raw(str):
    """A part that is spelled already."""


def parse(text: str):
    """Value of a JSON text: dict, list, str, Number, bool or None, however deep. ValueError where it isn't one."""
    at, stack, keys, want = 0, [], [], "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, string, number, named = m.groups()
        if mark == "{" or mark == "[":
            if want not in ("value", "value or end"):
                raise ValueError(f"unexpected {mark} at {at}")
            stack.append({} if mark == "{" else [])
            keys.append(None)
            want = "key or end" if mark == "{" else "value or end"
            continue
        if mark == ":":
            if want != "colon":
                raise ValueError(f"unexpected : at {at}")
            want = "value"
            continue
        if mark == ",":
            if want != "comma":
                raise ValueError(f"unexpected , at {at}")
            want = "key" if isinstance(stack[-1], dict) else "value"
            continue
        if mark:
            if not stack or want not in ("comma", "key or end", "value or end") or isinstance(stack[-1], dict) != (mark == "}"):
                raise ValueError(f"unexpected {mark} at {at}")
            value = stack.pop()
            keys.pop()
        elif want in ("key", "key or end"):
            if string is None:
                raise ValueError(f"no key at {at}")
            keys[-1], want = json.loads(string, strict=False), "colon"
            continue
        elif want not in ("value", "value or end"):
            raise ValueError(f"unexpected value at {at}")
        else:
            value = json.loads(string, strict=False) if string is not None else Number(number) if number is not None else _NAMED[named]
        if not stack:
            if text[at:].strip(" \t\r\n"):
                raise ValueError(f"more than a value at {at}")
            return value
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
        else:
            stack[-1].append(value)
        want = "comma"


def spell(value) -> str:
    """JSON text of a value that `parse` gave, without blanks."""
    out, stack = [], [(False, value)]
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, (Number, Raw)):
            out.append(str(v))
        elif isinstance(v, dict):
            inner = [(True, "{")]
            for k, x in v.items():
                inner += [(True, ("," if len(inner) > 1 else "") + json.dumps(k, ensure_ascii=False) + ":"), (False, x)]
            stack.extend(reversed([*inner, (True, "}")]))
        elif isinstance(v, list):
            inner = [(True, "[")]
            for x in v:
                inner += [(True, ",")] * (len(inner) > 1) + [(False, x)]
            stack.extend(reversed([*inner, (True, "]")]))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
