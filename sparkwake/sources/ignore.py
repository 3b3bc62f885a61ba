"""Rules of .gitignore files. The lines of a file become one regular expression, tried from the last line to the first, since the
last line that fits decides."""

from __future__ import annotations

import re
from functools import lru_cache


def _segment(text: str) -> str:
    """One name of a pattern: * and ? stop at /, [a-z] and [!a-z] are sets, a backslash takes the next character as it is."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(re.escape(text[i + 1]))
            i += 2
            continue
        close = text.find("]", i + 2 + text.startswith("!", i + 1)) if c == "[" else -1
        if close > 0:
            inside = text[i + 1 : close].replace("\\", "\\\\")
            out.append(f"(?!/)[{'^' + inside[1:] if inside[0] in '!^' else inside}]".replace("[[", "[\\["))
            i = close + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def expression(line: str) -> tuple[str, bool] | None:
    """The expression of a line for paths below its file, folders ending with /, and whether it takes back. None: no rule."""
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    pattern = line[back:]
    folder = pattern.endswith("/")
    parts = pattern.rstrip("/").lstrip("/").split("/")
    if not any(parts):
        return None
    anchored = pattern.startswith("/") or len(parts) > 1
    out = "" if anchored else "(?:.*/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return out + ("/" if folder else "/?"), back


class Rules:
    def __init__(self, text: str):
        found = [e for e in map(expression, text.split("\n")) if e]
        self.back = [back for _, back in found]
        tried = [f"(?P<r{n}>{e})" for n, (e, _) in reversed(list(enumerate(found)))]
        self.one = re.compile("|".join(tried), re.DOTALL) if tried else None

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """Whether the path, seen from the rules' folder, is ignored; None if no line speaks of it."""
        fits = self.one and self.one.fullmatch(path + "/" * is_folder)
        return None if not fits else not self.back[int(fits.lastgroup[1:])]


@lru_cache(maxsize=1000)
def rules_of(text: str) -> Rules:
    return Rules(text)


def is_ignored(path: str, is_folder: bool, files: list[tuple[str, str]]) -> bool:
    """files: (folder, text) of the .gitignore files above the path, from the root down. The nearest that speaks of it decides."""
    for base, text in reversed(files):
        said = rules_of(text).verdict(path[len(base) + 1 :] if base else path, is_folder)
        if said is not None:
            return said
    return False
