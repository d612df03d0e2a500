"""Builders for phrase and pattern tests, as SQL expression text.

Each helper takes and returns the text of a Spark SQL expression; callers wrap
the result in ``F.expr``.  A list of thirty phrases is one parsed expression
instead of a hundred Column calls, so plans are built quickly, and Catalyst
sees ordinary built-in functions.  Short phrase lists become OR-ed ``contains``
calls; the many lists of an operator share one pass over the text, see
``PhraseSet``.  Patterns are compiled once per task and, where a pattern cannot
match without a known literal, guarded by a test for that literal so that most
rows skip the regex.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

# every character the text features treat as white space at the ends of a text
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# Unicode classes for \w \d \s \b on every JVM version
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def filled(expr: str) -> str:
    """NULL text behaves as the empty text everywhere."""
    return f"coalesce({expr}, '')"


def stripped(expr: str) -> str:
    """Remove any Unicode white space from both ends (``trim`` strips blanks only)."""
    return f"btrim({expr}, {quoted(WHITESPACE)})"


def any_of(expr: str, phrases: Sequence[str]) -> str:
    """True when at least one phrase occurs as a substring."""
    return "(" + " OR ".join(f"contains({expr}, {quoted(p)})" for p in phrases) + ")"


class PhraseSet:
    """Many phrase lists tested with one pass over a text.

    A lookahead pattern in the shape of a prefix tree reports, at each position
    of the text, the longest listed phrase that starts there.  A phrase occurs
    as a substring exactly when it, or a longer phrase that begins with it, is
    among those reports, so list tests become look-ups in a short array.
    """

    def __init__(self, column: str, *lists: Sequence[str]) -> None:
        self.column = column
        self.phrases = sorted({p for phrases in lists for p in phrases})

    def found(self, expr: str) -> str:
        """The array to store in ``column`` for a text."""
        pattern = f"(?=({_prefix_tree(self.phrases)}))"
        return f"array_distinct(regexp_extract_all({expr}, {quoted(pattern)}, 1))"

    def at(self, column: str) -> "PhraseSet":
        """The same set, found in another column."""
        return PhraseSet(column, self.phrases)

    def _reports(self, phrases: Sequence[str]) -> list[str]:
        unknown = set(phrases) - set(self.phrases)
        if unknown:
            raise ValueError(f"phrases not in the set: {sorted(unknown)}")
        return [q for q in self.phrases if q.startswith(tuple(phrases))]

    def any_of(self, phrases: Sequence[str]) -> str:
        """True when at least one phrase occurs as a substring."""
        reports = self._reports(phrases)
        if len(reports) == 1:
            return f"array_contains({self.column}, {quoted(reports[0])})"
        # few phrases are found in a text, so they are looked up in the list, not the list in them
        return f"exists({self.column}, q -> q IN {quoted_list(reports)})"

    def hits(self, phrases: Sequence[str]) -> str:
        """Number of list entries found; a repeated entry counts once per listing."""
        return "(" + " + ".join(f"int({self.any_of([p])})" for p in phrases) + ")"


def _prefix_tree(phrases: Sequence[str]) -> str:
    """A pattern for the longest of the phrases, branching letter by letter."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branches(node: dict) -> list[str]:
        return [re.escape(letter) + pattern(child)
                for letter, child in sorted(node.items()) if letter]

    def pattern(node: dict) -> str:
        options = branches(node)
        if not options:
            return ""
        if len(options) == 1 and "" not in node:
            return options[0]
        return "(?:" + "|".join(options) + ")" + ("?" if "" in node else "")

    # the first letter is narrowed down in two steps
    letters, options = sorted(root), branches(root)
    groups = []
    for at in range(0, len(letters), 5):
        start = "".join(re.escape(c) for c in letters[at:at + 5])
        groups.append(f"(?=[{start}])(?:{'|'.join(options[at:at + 5])})")
    return "|".join(groups)


def matches(expr: str, pattern: str, nocase: bool = False, needs: str | Sequence[str] = ()) -> str:
    """Pattern search, skipped when it cannot succeed.

    ``needs`` is a cheap test that must hold, or literals of which one must be
    present in the expression.
    """
    flags = UNICODE_NOCASE if nocase else UNICODE
    test = f"rlike({expr}, {quoted(flags + pattern)})"
    if not needs:
        return test
    return f"({needs if isinstance(needs, str) else any_of(expr, needs)} AND {test})"


def count_matches(expr: str, pattern: str, nocase: bool = False) -> str:
    """Number of non-overlapping matches."""
    flags = UNICODE_NOCASE if nocase else UNICODE
    return f"bigint(regexp_count({expr}, {quoted(flags + pattern)}))"


def count_substring(expr: str, phrase: str) -> str:
    """Number of non-overlapping occurrences of a literal."""
    return (f"bigint((length({expr}) - length(replace({expr}, {quoted(phrase)}, ''))) "
            f"div {len(phrase)})")


def bounded(words: Sequence[str]) -> str:
    """A pattern that matches any of the words between word boundaries."""
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def either(patterns: Sequence[str]) -> str:
    """A pattern that matches any of the patterns."""
    return "(?:" + "|".join(patterns) + ")"


def has_word(expr: str, words: Sequence[str]) -> str:
    """True when a word or phrase of the list occurs between word boundaries."""
    return matches(expr, bounded(words), needs=words)


def distinct_words(expr: str, words: Sequence[str]) -> str:
    """How many different single words of the list occur between boundaries."""
    return (f"size(array_distinct(regexp_extract_all({expr}, "
            f"{quoted(UNICODE + bounded(words))}, 0)))")


def case(branches: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    """First-match-wins CASE from (condition, value) texts."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {whens} ELSE {default} END"


def mapped(expr: str, values: Mapping[str, str]) -> str:
    """CASE that maps string values to other expression texts."""
    whens = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in values.items())
    return f"CASE {expr} {whens} END"
