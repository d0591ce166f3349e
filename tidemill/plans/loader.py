"""Reads specs: a strict subset of YAML with no implicit surprises.

Block maps and sequences by indentation (spaces only), flow maps and sequences that may continue over
lines, comments outside quotes, single and double quotes. Only true, false, null, ~ and plain
integers and decimals are anything but strings. What isn't in the subset is an error with its line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class SpecError(ValueError):
    """A spec that can't be read or doesn't hold together."""


@dataclass
class Line:
    indent: int
    text: str
    number: int


ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "t": "\t", "/": "/"}


def _fail(number: int, what: str) -> SpecError:
    return SpecError(f"line {number}: {what}")


def _bare(raw: str, number: int, quote: str = "", depth: int = 0) -> tuple[str, str, int]:
    """The text before a comment, the quote that is open at its end, and the depth of open brackets."""
    i = 0
    while i < len(raw):
        ch = raw[i]
        if quote:
            if ch == "\\" and quote == '"':
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'" and (i == 0 or raw[i - 1] in " \t[{,:-("):
            quote = ch
        elif ch == "#" and (i == 0 or raw[i - 1] in " \t"):
            return raw[:i].rstrip(), quote, depth
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
            if depth < 0:
                raise _fail(number, "unbalanced brackets")
        i += 1
    return raw.rstrip(), quote, depth


def _lines(text: str) -> list[Line]:
    out: list[Line] = []
    open_, depth = "", 0
    for number, raw in enumerate(text.splitlines(), 1):
        body, open_, depth = _bare(raw, number, open_, depth) if depth else _bare(raw, number)
        if open_:
            raise _fail(number, "quote is not closed")
        if out and out[-1].number < 0:
            out[-1].text += " " + body.strip()
            if not depth:
                out[-1].number = -out[-1].number
            continue
        if not body.strip():
            continue
        lead = body[: len(body) - len(body.lstrip())]
        if "\t" in lead:
            raise _fail(number, "tabs can't indent")
        out.append(Line(len(lead), body.strip(), -number if depth else number))
    if depth:
        raise _fail(len(text.splitlines()), "unbalanced brackets")
    return out


def _scalar(token: str, number: int) -> object:
    token = token.strip()
    if token[:1] == '"':
        if len(token) < 2 or token[-1] != '"':
            raise _fail(number, "text after a closing quote")
        out, i, inner = "", 0, token[1:-1]
        while i < len(inner):
            if inner[i] == "\\":
                i += 1
                if i >= len(inner) or inner[i] not in ESCAPES:
                    raise _fail(number, "unknown escape")
                out += ESCAPES[inner[i]]
            elif inner[i] == '"':
                raise _fail(number, "text after a closing quote")
            else:
                out += inner[i]
            i += 1
        return out
    if token[:1] == "'":
        if len(token) < 2 or token[-1] != "'":
            raise _fail(number, "text after a closing quote")
        return token[1:-1].replace("''", "'")
    if token[:1] in ("&", "*", "!"):
        raise _fail(number, "anchors, aliases and tags are not supported")
    if token[:1] in ("|", ">"):
        raise _fail(number, "block scalars are not supported")
    if token in ("true", "false"):
        return token == "true"
    if token in ("null", "~", ""):
        return None
    if re.fullmatch(r"-?[0-9]+", token):
        return int(token)
    if re.fullmatch(r"-?[0-9]+\.[0-9]+", token):
        return float(token)
    return token


def _pieces(body: str, number: int) -> list[str]:
    """The parts of a flow collection between commas of its own level."""
    parts, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(body):
        ch = body[i]
        if quote:
            if ch == "\\" and quote == '"':
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'" and not body[start:i].strip().strip("[{"):
            quote = ch
        elif ch in "\"'" and body[:i].rstrip()[-1:] in ":[{,":
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
        i += 1
    if body[start:].strip():
        parts.append(body[start:])
    if any(not p.strip() for p in parts):
        raise _fail(number, "empty item")
    return [p.strip() for p in parts]


def _key(text: str, number: int) -> tuple[str, str] | None:
    """Key and rest of 'key: rest'; None if the text is no such pair."""
    if text[:1] in ("'", '"'):
        end = text.find(text[0], 1)
        while text[0] == '"' and end > 0 and text[end - 1] == "\\":
            end = text.find('"', end + 1)
        rest = text[end + 1 :].lstrip()
        if end < 0 or not rest.startswith(":"):
            return None
        return str(_scalar(text[: end + 1], number)), rest[1:].strip()
    m = re.match(r"([^:{}\[\],]+?)\s*:(?:\s+(.*)|$)", text, re.S)
    return (m[1], (m[2] or "").strip()) if m else None


def _flow(text: str, number: int) -> object:
    if text[:1] == "[":
        if text[-1] != "]":
            raise _fail(number, "text after a closing bracket")
        return [_flow(p, number) for p in _pieces(text[1:-1], number)]
    if text[:1] == "{":
        if text[-1] != "}":
            raise _fail(number, "text after a closing bracket")
        out: dict[str, object] = {}
        for p in _pieces(text[1:-1], number):
            pair = _key(p, number)
            if pair is None:
                raise _fail(number, f"{p!r} is no key: value pair")
            if pair[0] in out:
                raise _fail(number, f"duplicate key {pair[0]!r}")
            if pair[1][:1] not in ("'", '"', "[", "{") and re.search(r":\s", pair[1]):
                raise _fail(number, "quote values with a colon")
            out[pair[0]] = _flow(pair[1], number)
        return out
    return _scalar(text, number)


def _block(lines: list[Line], at: int, indent: int) -> tuple[object, int]:
    if lines[at].indent != indent:
        raise _fail(lines[at].number, "unexpected indentation")
    if lines[at].text == "-" or lines[at].text.startswith("- "):
        items: list[object] = []
        while at < len(lines) and lines[at].indent == indent and (lines[at].text == "-" or lines[at].text.startswith("- ")):
            line = lines[at]
            rest = line.text[1:].lstrip()
            if not rest:
                if at + 1 >= len(lines) or lines[at + 1].indent <= indent:
                    raise _fail(line.number, "empty sequence item")
                value, at = _block(lines, at + 1, lines[at + 1].indent)
            elif rest[0] not in "[{" and _key(rest, line.number) is not None:
                inner = indent + len(line.text) - len(rest)
                lines[at] = Line(inner, rest, line.number)
                value, at = _block(lines, at, inner)
            else:
                value, at = _flow(rest, line.number), at + 1
            items.append(value)
        if at < len(lines) and lines[at].indent > indent:
            raise _fail(lines[at].number, "unexpected indentation")
        return items, at
    out: dict[str, object] = {}
    while at < len(lines) and lines[at].indent == indent:
        line = lines[at]
        pair = None if line.text.startswith("- ") else _key(line.text, line.number)
        if pair is None:
            raise _fail(line.number, f"{line.text!r} is no key: value pair")
        key, rest = pair
        if key in out:
            raise _fail(line.number, f"duplicate key {key!r}")
        if rest:
            out[key], at = _flow(rest, line.number), at + 1
        elif at + 1 < len(lines) and (lines[at + 1].indent > indent or lines[at + 1].indent == indent and lines[at + 1].text.startswith("- ")):
            out[key], at = _block(lines, at + 1, lines[at + 1].indent)
        else:
            out[key], at = None, at + 1
        if at < len(lines) and lines[at].indent > indent:
            raise _fail(lines[at].number, "unexpected indentation")
    return out, at


def load(text: str) -> dict[str, object]:
    lines = _lines(text)
    if not lines:
        raise SpecError("the spec is empty")
    value, at = _block(lines, 0, lines[0].indent)
    if at < len(lines):
        raise _fail(lines[at].number, "unexpected indentation")
    if not isinstance(value, dict):
        raise SpecError("the top level of a spec is a map")
    return value
