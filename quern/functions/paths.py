"""Member names as column expressions: globs, ancestors, safety, stripping, escaping. Everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob whose ``*`` and ``?`` also match ``/``, in the common subset of Java and RE2.

    Sets take ranges and ``!`` or ``^``; a set without end is an ordinary bracket; a backslash takes the next character
    as it is. A leading ``./`` doesn't count.
    """
    p = pattern.removeprefix("./")
    out, i = [], 0
    while i < len(p):
        c = p[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(p):
            out.append(_literal(p[i]))
            i += 1
        elif c == "[" and (parsed := _bracket(p, i)):
            body, i = parsed
            out.append(body)
        else:
            out.append(_literal(c))
    return "(?s)^" + "".join(out) + "$"


def _literal(c: str) -> str:
    return "\\" + c if re.match(r"[\\.\[\]{}()*+?^$|\-]", c) else c


def _bracket(p: str, i: int) -> tuple[str, int] | None:
    """The set that begins behind a bracket at i - 1, and where it ends."""
    negated = i < len(p) and p[i] in "!^"
    i += negated
    members: list[str] = []
    first = True
    while i < len(p) and (p[i] != "]" or first):
        first = False
        if p[i] == "\\" and i + 1 < len(p):
            i += 1
        low = p[i]
        if i + 2 < len(p) and p[i + 1] == "-" and p[i + 2] != "]":
            if low <= p[i + 2]:
                members.append(f"{_literal(low)}-{_literal(p[i + 2])}")
            i += 3
        else:
            members.append(_literal(low))
            i += 1
    if i >= len(p):
        return None
    if not members:  # only empty ranges
        return ("[^\\x{0}-\\x{10FFFF}]" if not negated else ".", i + 1)
    return f"[{'^' if negated else ''}{''.join(members)}]", i + 1


def bare(name: Column) -> Column:
    return F.regexp_replace(name, r"^\./", "")


def parts(name: Column) -> Column:
    return F.split(name, "/")


def ancestors(name: Column) -> Column:
    """All proper directory prefixes of a name, shortest first."""
    p = parts(name)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def glob_matches(name: Column, pattern: str) -> Column:
    """Whether one glob drops a name itself, a directory that it is in, or, without ``/``, any of its components.

    A directory is tried with a ``/`` behind it too, so ``src/*`` drops ``src`` and all that is in it.
    """
    regex, n = glob_regex(pattern), bare(name)
    a = F.transform(ancestors(n), lambda x: F.concat(x, F.lit("/")))
    tried = F.concat(F.array(n), a, ancestors(n))
    if "/" not in pattern.removeprefix("./"):
        tried = F.concat(tried, parts(n))
    return F.exists(tried, lambda x: x.rlike(regex))


def excluded(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_matches(name, p)
    return out


def unsafe_reason(name: Column) -> Column:
    """Why a name must not be written, or null."""
    return F.when(name.startswith("/"), F.lit("Path is absolute")).when(F.array_contains(parts(name), ".."), F.lit("Path contains '..'"))


def sanitised(name: Column) -> Column:
    """Without leading slashes."""
    return F.regexp_replace(name, r"^/+", "")


def strip_components(name: Column, n: int) -> Column:
    """Without its first n components; empty if it has no more."""
    p = parts(name)
    return F.array_join(F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0))), "/")


def without_parent_prefix(name: Column) -> Column:
    """Without everything through its last ``..`` component."""
    return F.regexp_replace(name, r"^(.*/)?\.\./", "")


def escaped(name: Column) -> Column:
    """Control characters as backslash and three octal digits."""
    chars = F.split(name, "")
    one = lambda c: F.when((F.ascii(c) < 32) & (c != "") | (F.ascii(c) == 127), F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(c).cast("string"), 10, 8), 3, "0"))).otherwise(c)
    return F.array_join(F.transform(chars, one), "")


# Suffixes of files that are compressed already.
COMPRESSED_SUFFIXES = [
    "zip", "zipx", "gz", "tgz", "bz2", "tbz2", "tbz", "xz", "txz", "7z", "rar", "zst", "tzst", "lz4", "lz4a", "lz", "tlz", "lzma", "z", "br", "cab",
    "lzfse", "lzfse.apple",
    "jar", "war", "apk", "aab", "ipa", "xip", "whl", "nupkg", "epub", "docx", "xlsx", "pptx", "odt", "ods", "odp", "dmg", "pkg",
    "mp4", "m4v", "mov", "mkv", "webm", "avi", "wmv", "flv", "mpg", "mpeg", "m2v", "m2ts", "mts", "3gp", "hevc", "h264", "h265",
    "mp3", "aac", "m4a", "ogg", "oga", "opus", "flac", "wma",
    "jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "avif", "jxl",
]


def is_compressed(name: Column) -> Column:
    """By the name's suffix alone, whatever its case."""
    low = F.lower(F.element_at(parts(name), -1))
    last, two = F.regexp_extract(low, r"\.([^.]+)$", 1), F.regexp_extract(low, r"\.([^.]+\.[^.]+)$", 1)
    return last.isin(COMPRESSED_SUFFIXES) | two.isin(COMPRESSED_SUFFIXES)


def permitted_mode(mode: Column, umask: int, same_permissions: bool) -> Column:
    """The mode to write: as it is, or without setuid, setgid, sticky and what the umask holds back."""
    return mode if same_permissions else mode.bitwiseAND(F.lit(0o777 & ~umask))
