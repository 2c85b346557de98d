"""Regexes without look-around or back references, as automata can run them, for Java's engine."""

from __future__ import annotations

import re

#: POSIX classes and what Java calls them (fixed values).
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "graph": r"\p{Graph}", "print": r"\p{Print}", "word": r"\w", "ascii": r"\p{ASCII}"}
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([A-Za-z-]*)([:)])|(.{0,2}))", re.S)


class BadRegex(ValueError):
    """A regex that can't be taken over."""


def to_java(pattern: str) -> str:
    return translate(pattern)[0]


def translate(pattern: str) -> tuple[str, dict[str, int]]:
    """Java's form of a regex, with named groups made positional, and the names' numbers."""
    out: list[str] = []
    names: dict[str, int] = {}
    group, depth, i, in_class = 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if not e:
                raise BadRegex("a trailing backslash")
            if e in "123456789kGZ" and not in_class:
                raise BadRegex(f"\\{e} isn't supported")
            if e == "Q":
                end = pattern.find("\\E", i + 2)
                out.append(re.sub(r"([^\w\s])", r"\\\1", pattern[i + 2 : end if end >= 0 else len(pattern)]))
                i = end + 2 if end >= 0 else len(pattern)
                continue
            out.append("\\x07" if e == "a" else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                if m[2] not in POSIX:
                    raise BadRegex(f"unknown class {m[0]}")
                java = POSIX[m[2]]
                out.append(java if not m[1] else java.swapcase() if java in (r"\s", r"\w") else java.replace(r"\p", r"\P"))
                i += m.end()
                continue
            # Java gives [ and && a meaning inside a class.
            out.append("\\" + c if c in "[&" else c)
            in_class = c != "]"
        elif c == "[":
            in_class = True
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m[0].replace("]", "\\]"))
            i += m.end()
            continue
        elif c == "(":
            depth += 1
            if pattern[i + 1 : i + 2] == "?":
                m = _GROUP.match(pattern, i)
                if m[1]:
                    group += 1
                    names[m[1]] = group
                    out.append("(")
                elif m[3]:
                    if set(m[2]) - set("ims-"):
                        raise BadRegex(f"flags {m[2]!r} aren't supported")
                    out.append(m[0])
                    depth -= m[3] == ")"
                else:
                    raise BadRegex("look-around and other extensions aren't supported")
                i = m.end()
                continue
            group += 1
            out.append(c)
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise BadRegex("an unopened group")
            out.append(c)
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise BadRegex("possessive repeats aren't supported")
        else:
            out.append("\\z" if c == "$" and "(?m" not in pattern else c)
        i += 1
    if in_class or depth:
        raise BadRegex("an unclosed class or group")
    java = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", r"\\w", java).replace("\\z", "$"))
    except re.error as e:
        raise BadRegex(str(e)) from None
    return java, names
