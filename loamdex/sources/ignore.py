"""Patterns of files to leave out, as in .gitignore files."""

from __future__ import annotations

import os
import re
from functools import lru_cache


@lru_cache(maxsize=4096)
def _regex(pattern: str) -> re.Pattern | None:
    """A pattern for a path relative to the folder of its file; None if it can't be read."""
    body = pattern.strip("/")
    if not body:
        return None
    anchored = "/" in pattern.rstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.+")
            break
        c = body[i]
        if c == "*":
            out.append("[^/]*")
            while body[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append(re.escape(c))
        i += 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out))
    except re.error:
        return None


class Rules:
    """The patterns of one file, for paths below its folder. The last that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            regex = _regex(line.rstrip("/") if line.endswith("/") else line)
            if regex:
                self.rules.append((regex, line.endswith("/"), keep))

    @classmethod
    def read(cls, path: str) -> Rules | None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return cls(f.readlines())
        except OSError:
            return None

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True to leave out, False to keep, None if no pattern matches."""
        for regex, only_dirs, keep in reversed(self.rules):
            if (is_dir or not only_dirs) and regex.fullmatch(path):
                return not keep
        return None


def global_rules() -> Rules | None:
    """The user's own patterns."""
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return Rules.read(os.path.join(base, "git", "ignore"))


class Overrides:
    """Include and exclude globs. An exclude leaves out; with any include, files that match none are left out."""

    def __init__(self, include: list[str], exclude: list[str]):
        self.rules = [(r, p.endswith("/"), True) for p in include if (r := _regex(p.rstrip("/")))]
        self.includes = bool(self.rules)
        # Excludes are asked first, as they come before the includes.
        self.excludes = [(r, p.endswith("/")) for p in exclude if (r := _regex(p.rstrip("/")))]

    def left_out(self, path: str, is_dir: bool) -> bool:
        for regex, only_dirs, _ in reversed(self.rules):
            if (is_dir or not only_dirs) and regex.fullmatch(path):
                return False
        if any((is_dir or not only) and regex.fullmatch(path) for regex, only in self.excludes):
            return True
        return self.includes and not is_dir
