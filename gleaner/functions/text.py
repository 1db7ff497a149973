"""String Column functions with the exact semantics of the collector's Python code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters Python's str.strip() removes (str.isspace), as a regex class
# that Java and RE2 both accept
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The characters of ``WS_CLASS``.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# fixed values: the default refine rules, applied in this order after custom rules
# (case-insensitive, each match deleted)
DEFAULT_REPLACE_RULES = (
    r'\s+(class|id)=".*?"',
    r"<script.*?</script>",
    r"<a .*?>|</a>",
    r"<h\d.*</h\d>",
)


def py_strip(c: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(c.cast("string"), F.lit(WS_CHARS))


def py_rstrip_char(c: Column, ch: str) -> Column:
    """``str.rstrip(ch)`` for a single literal character."""
    return F.regexp_replace(c, "\\" + ch + "+$", "") if not ch.isalnum() else F.regexp_replace(c, ch + "+$", "")


def _rule_pair(rule):
    if isinstance(rule, (tuple, list)):
        pattern, repl = rule[0], (rule[1] if len(rule) > 1 else "")
    else:
        pattern, repl = rule, ""
    return pattern, repl


def _java_repl(repl: str) -> str:
    # literal replacement text: escape Java's group/escape markers
    return repl.replace("\\", "\\\\").replace("$", "\\$")


def refine(c: Column, custom_rules=None) -> Column:
    """O-28: ``refine_content``.

    Without custom rules the value is unchanged. Otherwise: drop every ``\\n``,
    strip, apply each custom rule (case-insensitive) then the four default rules.
    ``(?d)`` makes ``.`` stop only at ``\\n`` as in Python (after the newline
    removal it matters only for ``\\r`` and Unicode line separators).
    """
    if not custom_rules:
        return c
    out = py_strip(F.regexp_replace(c, "\n", ""))
    for rule in list(custom_rules) + list(DEFAULT_REPLACE_RULES):
        pattern, repl = _rule_pair(rule)
        out = F.regexp_replace(out, "(?id)" + pattern, _java_repl(repl))
    return out


def refine_array(c: Column, custom_rules=None) -> Column:
    """O-28 over an array of values."""
    if not custom_rules:
        return c
    return F.transform(c, lambda v: refine(v, custom_rules))


def normalise_words(words) -> list:
    """Black words as configured: a comma list or a sequence; trimmed, lower-cased, no blanks."""
    if words is None:
        return []
    if isinstance(words, str):
        words = words.split(",")
    return [w.strip().lower() for w in words if w and w.strip()]


def contains_any(text: Column, words) -> Column:
    """O-27 test: does the lower-cased text contain any black word as a substring."""
    words = normalise_words(words)
    if not words:
        return F.lit(False)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.instr(low, F.lit(w)) > 0 for w in words])


def contains_any_col(text: Column, words: Column) -> Column:
    """O-27 test with per-row words (an ``ARRAY<STRING>`` column of lower-case words)."""
    low = F.lower(text)
    return F.coalesce(F.exists(words, lambda w: (F.length(w) > 0) & (F.instr(low, w) > 0)), F.lit(False))
