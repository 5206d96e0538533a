"""Repair of recognized TeX: commands run together with letters, fences left open, doubled scripts.

Plain Python without Spark. Null stays null; so does what has unbalanced braces.
"""

from __future__ import annotations

import re

from .mathml import known_commands

_COMMAND = re.compile(r"\\([A-Za-z]+)")
_TOKEN = re.compile(r"\\(?:[A-Za-z]+|.)|.", re.S)
#: After these a script belongs to a new atom.
BOUNDARIES = frozenset("+-=<>()[],;|/& \t\n\r$")


def split_commands(tex: str) -> str:
    """A space after the longest known command that begins an unknown run of letters."""
    known = known_commands()

    def one(found: re.Match) -> str:
        run = found[1]
        if run in known:
            return found[0]
        cut = next((k for k in range(len(run) - 1, 0, -1) if run[:k] in known), 0)
        return f"\\{run[:cut]} {run[cut:]}" if cut else found[0]

    return _COMMAND.sub(one, tex)


def close_fences(tex: str) -> tuple[str, int]:
    n = len(re.findall(r"\\left(?![A-Za-z])", tex)) - len(re.findall(r"\\right(?![A-Za-z])", tex))
    return tex + " \\right." * max(n, 0), max(n, 0)


def separate_scripts(tex: str) -> tuple[str, int] | None:
    """An empty atom between two scripts of one kind on one atom; null if braces do not balance."""
    levels: list[set[str]] = [set()]
    out, splits = [], 0
    for found in _TOKEN.finditer(tex):
        token = found[0]
        if token == "{":
            levels.append(set())
        elif token == "}":
            if len(levels) == 1:
                return None
            levels.pop()
        elif token in "^_":
            if token in levels[-1]:
                out.append("{}")
                splits += 1
            levels[-1].add(token)
        elif token in BOUNDARIES:
            levels[-1].clear()
        out.append(token)
    return ("".join(out), splits) if len(levels) == 1 else None


def sanitize(tex: str) -> tuple[str, int, int] | None:
    fenced, closed = close_fences(split_commands(tex))
    done = separate_scripts(fenced)
    return None if done is None else (done[0], closed, done[1])
