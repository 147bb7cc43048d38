"""Sensitive-data patterns: redaction, findings and an ordered registry."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.arrays import let, sums_before

#: Names and patterns, in order of application.
PATTERNS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "aws_secret_key": r"(?i)aws_secret_access_key\s*[=:]\s*\S+",
    "github_token": r"gh[pousr]_[A-Za-z0-9_]{36,}",
    "generic_api_key": r"(?i)(api[_-]?key|apikey|access[_-]?token)\s*[=:]\s*['\"]?[A-Za-z0-9\-_.]{20,}['\"]?",
    "bearer_token": r"Bearer\s+[A-Za-z0-9._\-]+",
    "private_key": r"-----BEGIN\s+(RSA|DSA|EC|OPENSSH)?\s*PRIVATE KEY-----",
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "jwt": r"eyJ[A-Za-z0-9-_]+\.eyJ[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+",
    "connection_string": r"(?i)(mongodb|postgres|mysql|redis)://\S+",
}


#: Longest pattern that is taken.
LONGEST = 500


def repeats_a_repetition(pattern: str) -> bool:
    """Whether a group that holds a repetition is itself repeated, which may take exponential time to match."""
    at, holds, closed = 0, [False], False
    while at < len(pattern):
        c = pattern[at]
        if c == "[":  # a class, up to its end
            at += 2 if pattern[at + 1 : at + 2] in ("]", "^") else 1
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            closed = False
        elif c == "(":
            holds.append(False)
            # a mark after the bracket names the kind of group
            at += 1 if pattern[at + 1 : at + 2] == "?" else 0
            closed = False
        elif c == ")":
            inner = holds.pop() if len(holds) > 1 else False
            holds[-1] |= inner
            closed = inner
        elif c in "*+{":
            if closed:
                return True
            holds[-1] = True
        else:
            if c == "?" and pattern[at - 1 : at] not in ("*", "+", "}", "?"):
                holds[-1] = True
            at += c == "\\"
            closed = False
        at += 1
    return False


class Registry:
    """Ordered patterns, open to additions."""

    def __init__(self, patterns: dict[str, str] | None = None):
        self.patterns = dict(PATTERNS if patterns is None else patterns)

    def add(self, name: str, pattern: str) -> None:
        """Adds or replaces a pattern. Refused: overlong ones, those that repeat a repetition, and what doesn't compile here or, with a session, in the JVM."""
        if len(pattern) > LONGEST or repeats_a_repetition(pattern):
            raise ValueError(f"pattern {name!r} may take exponential time")
        try:
            re.compile(pattern)
            session = SparkSession.getActiveSession()
            if session is not None:
                session._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, PySparkException) as e:
            raise ValueError(f"pattern {name!r} doesn't compile: {e}") from e
        self.patterns[name] = pattern

    def listed(self) -> list[dict]:
        return [{"name": name, "pattern": pattern, "own": name not in PATTERNS} for name, pattern in self.patterns.items()]

    def key(self) -> str:
        """What results depend on."""
        return "\n".join(f"{name}={pattern}" for name, pattern in self.patterns.items())


def scrubbed(text: Column, registry: Registry | None = None) -> Column:
    """text with every match replaced by [REDACTED_NAME], pattern after pattern."""
    for name, pattern in (registry or Registry()).patterns.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED_{name.upper()}]")
    return text


def findings(text: Column, registry: Registry | None = None) -> Column:
    """Array of (type, start, end, preview): all patterns on the text as it stands, offsets in characters."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<type:string,start:int,end:int,preview:string>>")
    return F.concat(*[F.when(text.rlike(pattern), _found(text, name, pattern)).otherwise(none) for name, pattern in (registry or Registry()).patterns.items()])


def _found(text: Column, name: str, pattern: str) -> Column:
    """Matches with their places: what stands before each is one running sum over the gaps and the matches."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n")))

    def one(p: Column, before: Column) -> Column:
        start = before + p["gap"]
        preview = F.concat(F.lit("("), F.repeat(F.lit("*"), F.least(p["n"], F.lit(16))), F.lit(")[len="), p["n"].cast("string"), F.lit("]"))
        return F.struct(F.lit(name).alias("type"), start.alias("start"), (start + p["n"]).alias("end"), preview.alias("preview"))

    def all_(ps: Column) -> Column:
        before = sums_before(F.transform(ps, lambda p: p["gap"] + F.coalesce(p["n"], F.lit(0))))
        # the gap after the last match has none of its own
        return F.filter(F.zip_with(ps, before, one), lambda f: f["end"].isNotNull())

    return let(pieces, all_)


def scrub_content(nodes: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Nodes with scrubbed content; token counts stay as they are."""
    return nodes.withColumn("content", scrubbed(F.col("content"), registry))
