"""Which files a scan leaves out: rules of ignore files, level by level."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

#: Read in each folder, in this order; later rules win.
IGNORE_FILES = (".searchignore", ".gitignore")
#: Names that are left out at any level.
DEFAULTS = (".git", "node_modules", ".searchindex")


@dataclass(frozen=True)
class Rule:
    pattern: str
    source: str
    line: int
    negate: bool = False
    folders_only: bool = False
    anchored: bool = False

    def describe(self) -> str:
        return f"{self.pattern} ({self.source}:{self.line})"

    @cached_property
    def _regex(self) -> re.Pattern:
        parts = self.pattern.split("/")
        out = ""
        for k, part in enumerate(parts):
            if part == "**":
                out += "(?:[^/]+/)*" if k < len(parts) - 1 else "(?:[^/]+(?:/|$))*"
                continue
            out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part)
            out += "/" if k < len(parts) - 1 else ""
        start = "" if self.anchored else "(?:[^/]+/)*"
        return re.compile(f"{start}{out}(?:/.*)?", re.DOTALL)

    def matches(self, path: str) -> bool:
        """Whether ``path`` or a folder that it is in meets the pattern."""
        return self._regex.fullmatch(path) is not None


def parse_rules(source: str, content: str) -> list[Rule]:
    rules = []
    for number, line in enumerate(content.split("\n"), 1):
        text = line.rstrip(" \t\r")
        if not text or text.startswith("#"):
            continue
        negate = text.startswith("!")
        text = text[negate:]
        folders = text.endswith("/")
        text = text.removesuffix("/")
        anchored = "/" in text
        text = text.removeprefix("/") if text.startswith("/") else text.removeprefix("./") if anchored else text
        if text:
            rules.append(Rule(text, source, number, negate, folders, anchored))
    return rules


def folder_rules(folder: Path, base: Path) -> list[Rule]:
    """The rules of one folder's ignore files; their source is relative to ``base``."""
    rules = []
    for name in IGNORE_FILES:
        file = folder / name
        if file.is_file() and not file.is_symlink():
            rules += parse_rules(file.relative_to(base).as_posix(), file.read_text(errors="replace"))
    return rules


@dataclass(frozen=True)
class Levels:
    """Rules of the folders from the base down to a file's."""

    levels: tuple[tuple[Rule, ...], ...] = ()

    def below(self, rules: list[Rule]) -> Levels:
        return Levels((*self.levels, tuple(rules)))

    def deciding(self, path: str) -> Rule | None:
        """The rule that decides on ``path`` (from the base): of the deepest folder that has one, the last."""
        for name in DEFAULTS:
            if name in path.split("/"):
                return Rule(name + "/", "(default)", 0)
        for rules in reversed(self.levels):
            hit = next((r for r in reversed(rules) if r.matches(path)), None)
            if hit:
                return hit
        return None

    def ignored(self, path: str) -> bool:
        rule = self.deciding(path)
        return rule is not None and not rule.negate


def levels_of(path: str, base: Path) -> Levels:
    """The levels above one file."""
    out, folder = Levels(), base
    out = out.below(folder_rules(folder, base))
    for part in Path(path).parts[:-1]:
        folder = folder / part
        out = out.below(folder_rules(folder, base))
    return out
