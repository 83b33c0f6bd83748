"""Human-readable sizes and times, name patterns, and other small scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]


def format_bytes(n: Column) -> Column:
    """``1,024 (1.0 KiB)``; below 1024 only the number."""
    n = n.cast("long")
    scaled = F.lit(None).cast("string")
    for power in range(1, len(UNITS)):
        scaled = F.when(n >= 1024**power, F.concat(_tenths(n, 10 * power), F.lit(f" {UNITS[power]}"))).otherwise(scaled)
    plain = F.format_number(n, 0)
    return F.when(scaled.isNull(), plain).otherwise(F.concat(plain, F.lit(" ("), scaled, F.lit(")")))


def _tenths(n: Column, bits: int) -> Column:
    """n / 2**bits, as a double, with one decimal as C and Python print it: ties to even, where Java rounds them up."""
    n = n.cast("double").cast("long")
    rest = n.bitwiseAND(F.lit((1 << bits) - 1).cast("long")) * 10
    down, left, half = F.shiftright(rest, bits), rest.bitwiseAND(F.lit((1 << bits) - 1).cast("long")), 1 << bits - 1
    digit = down + ((left > half) | ((left == half) & (down % 2 == 1))).cast("long")
    return F.concat((F.shiftright(n, bits) + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def format_time_delta(seconds: Column) -> Column:
    """The two largest units: ``1d 2h``, ``3h 4m``, ``5m 6s`` or ``7s``."""
    s = F.floor(seconds.cast("double")).cast("long")
    part = lambda big, a, small, b: F.concat(F.floor(s / big).cast("string"), F.lit(f"{a} "), F.floor(s % big / small).cast("string"), F.lit(b))
    return F.when(s >= 86400, part(86400, "d", 3600, "h")).when(s >= 3600, part(3600, "h", 60, "m")).when(s >= 60, part(60, "m", 1, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression that Java and Python read alike."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] == "!") + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def globs_to_regex(patterns: list[str]) -> str:
    return "^(?s:" + "|".join(f"(?:{glob_to_regex(p)})" for p in patterns) + ")$" if patterns else "^(?!)$"


def split_patterns(given: list[str] | None, default: str) -> list[str]:
    """Patterns of options such as ``.git,CVS``; what the user gives replaces the default."""
    return [p for text in (given or [default]) for p in text.split(",") if p]


def similarity_of(distance: Column, iht: int) -> Column:
    return 1 - distance / F.lit(100.0 if iht == 1 else 64.0)


def max_distance(similarity: float, iht: int) -> int:
    """The largest distance of a similarity: inclusive for 64-bit signatures, exclusive for histograms (iht 1)."""
    if iht == 1:
        most = int(100 * (1 - similarity))
        if not 0 < most <= 32:
            raise ValueError(f"similarity {similarity} is out of range for histograms: 0.68 to below 1")
        return most
    most = int(64 * (1 - similarity))
    if not 0 <= most <= 15:
        raise ValueError(f"similarity {similarity} is out of range for signatures: above 0.75 to 1")
    return most


def comparison_columns(size: Column, width: Column, height: Column) -> dict[str, Column]:
    """What a reviewer weighs between two images: file size, pixels, bytes for each pixel."""
    pixels = width.cast("long") * height
    return {"size": size, "pixels": pixels, "bytes_per_pixel": F.try_divide(size.cast("double"), pixels)}


def better_of(left: Column, right: Column) -> Column:
    """1, 0 or -1: which side has the larger value."""
    return F.signum(left - right).cast("int")


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def threads_of(spec: str, cores: int) -> int:
    """``4``, ``C`` (one for each core) or ``1.5C``."""
    n = (float(spec[:-1] or 1) * cores) if spec.endswith("C") else float(spec)
    if n < 1:
        raise ValueError(f"no threads: {spec}")
    return int(n)


def wrap_path(path: str, width: int = 30) -> str:
    """The path over several lines of about width characters, cut after slashes."""
    lines, line = [], ""
    for piece in re.findall(r"[^/]*/|[^/]+$", path):
        if line and len(line) + len(piece) > width:
            lines.append(line)
            line = ""
        line += piece
    return "\n".join([*lines, line])


def fit_into(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int]:
    """The size of a thumbnail that keeps the proportions and never enlarges."""
    scale = min(1.0, most_width / width, most_height / height)
    return max(1, int(width * scale)), max(1, int(height * scale))
