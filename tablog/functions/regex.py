"""Full-match regular expressions on top of ``rlike``, which searches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession


# Characters that mean more than themselves outside of a character class.
META = set("\\[](){}.^$?*+|")
# Escapes that stand for a class of characters, a place or a control character,
# and take nothing of what follows.
PLAIN_ESCAPES = set("dDwWsShHvVbBRtnrfae")
# Shorter texts, and more alternatives, tell too few lines apart.
LEAST_LETTERS, MOST_BRANCHES = 2, 8

# Fixed value: the condition of Spark's error for a pattern that does not compile.
INVALID_PATTERN = "INVALID_PARAMETER_VALUE.PATTERN"


def regex_body(query: str) -> str | None:
    """The pattern of a ``/pattern/`` query, or None for plain text."""
    if len(query) >= 2 and query[0] == "/" and query[-1] == "/":
        return query[1:-1]
    return None


@lru_cache(maxsize=1024)
def _compiles(pattern: str) -> bool:
    # Constant-folded on the driver: no Spark job runs.
    spark = SparkSession.active()
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except PySparkException as error:
        if (error.getCondition() or "").startswith(INVALID_PATTERN):
            return False
        raise
    return True


@lru_cache(maxsize=1024)
def full_match_pattern(body: str) -> str | None:
    """``body`` anchored to the whole text, or None if ``body`` is invalid.

    The bare pattern decides validity: ``a)(b`` is invalid although it would
    compile once wrapped.  An open ``\\Q`` quote or a trailing comment under
    ``(?x)`` would swallow the closing anchor, so the wrapped form that
    compiles is taken.
    """
    if not _compiles(body):
        return None
    for tail in ("", "\\E", "\n", "\\E\n"):
        wrapped = f"\\A(?:{body}{tail})\\z"
        if _compiles(wrapped):
            return wrapped
    raise ValueError(f"cannot anchor the pattern {body!r}")


def matches(text: Column, wrapped: str) -> Column:
    return text.rlike(wrapped)


def required_texts(body: str) -> list[str] | None:
    """Texts of which every match of a valid pattern holds at least one; None if that is not certain.

    Of each alternative the longest run of characters that stand for
    themselves, outside of groups and not optional.  Patterns with flags,
    quotes, or escapes and classes of the rarer kinds are left alone.
    """
    runs: list[list[str]] = [[]]
    run, depth, at = "", 0, 0

    def ended() -> str:
        if run and depth == 0:
            runs[-1].append(run)
        return ""

    while at < len(body):
        char = body[at]
        if char == "\\":
            next_char = body[at + 1 : at + 2]
            if next_char.isascii() and next_char and not next_char.isalnum():
                run = run + next_char if depth == 0 else ""
            elif next_char in PLAIN_ESCAPES:
                run = ended()
            else:
                return None
            at += 2
            continue
        if char == "[":
            run = ended()
            end = _class_end(body, at)
            if end is None:
                return None
            at = end
        elif char == "(":
            if body[at + 1 : at + 2] == "?":
                return None
            run = ended()
            depth += 1
        elif char == ")":
            run, depth = "", depth - 1
        elif char == "|":
            run = ended()
            if depth == 0:
                runs.append([])
        elif char in "?*{":
            run = run[:-1]  # what stands before it may be missing
            run = ended()
            if char == "{":
                at = body.find("}", at)
                if at < 0:
                    return None
        elif char in META:
            run = ended()
        elif depth == 0:
            run += char
        at += 1
    run = ended()
    best = [max(found, key=len, default="") for found in runs]
    if len(best) > MOST_BRANCHES or min(map(len, best)) < LEAST_LETTERS:
        return None
    return best


def _class_end(body: str, start: int) -> int | None:
    """Where a simple character class ends; None for nested and unusual ones."""
    at = start + 1 + (body[start + 1 : start + 2] == "^")
    first = at
    while at < len(body):
        char = body[at]
        if char == "\\":
            if body[at + 1 : at + 2] in ("Q", ""):
                return None
            at += 2
            continue
        if char == "[" or body[at : at + 2] == "&&" or char == "]" and at == first:
            return None
        if char == "]":
            return at
        at += 1
    return None
