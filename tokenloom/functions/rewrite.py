r"""Apply an ordered list of substitution rules to a text column.

The rules travel as one constant array and are folded over the text, so the plan stays one
expression however long the list is. Before the fold each row drops the rules that cannot
match: every word a pattern demands must occur somewhere in the text, also inside another word,
which an earlier rule may take away, or in the output of an earlier rule that itself may apply. Where
a rule may join what stands on its two sides, all rules are tried. A substring test is far cheaper
than a scan with a pattern.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.columns import let
from tokenloom.functions.text import SPACE, unicode_pattern

RULE_TYPE = (
    "array<struct<pattern:string,replacement:string,needs:array<array<string>>,glue:string>>"
)
Rule = tuple[str, str]
_BORDER, _UNSURE = "\x00", "\x01"
# Letters that match an ASCII letter where case is told by Unicode, and those letters.
FOLDING = ("ſıİ\u212a", "siik")


def needed_words(pattern: str, ascii: bool = False) -> list[tuple[set[str], set[str]]]:
    """What every match of ``pattern`` contains: for each entry one of its words or parts.

    Words stand alone in the match, parts may touch other letters. All lower case. Where borders are
    ``ascii``, letters beyond it are parts of their own: an earlier rule's output may stand beside them.
    """
    if pattern == " {2,}":
        return [(set(), {"  "})]
    p = re.sub(r"\(\?[a-zA-Z]+\)|\?-i:", "", pattern)
    p = re.sub(r"\\b|\\s\+|\[- \]", _BORDER, p)
    p = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})*", _UNSURE, p)
    p = re.sub(r"\\[BdDwWsS](?:[?*+]|\{[^}]*\})*", _UNSURE, p)
    p = re.sub(r"\\.", _BORDER, p)
    p = re.sub(r"\(\?(?:=|!|<=|<!)(?:[^()]|\([^()]*\))*\)", _UNSURE, p)
    p = re.sub(r"[ ',/-]", _BORDER, p)
    p = re.sub(rf"{_BORDER}(?:\((?:[^()|]*{_BORDER}\|)*[^()|]*{_BORDER}\)\?)+", _BORDER, p).lower()
    needs = []

    def choice(match: re.Match) -> str:
        """A group of plain words, not inside another group, is one entry of its own."""
        options = re.split(r"\|", match[1])
        outside = p[: match.start()].count("(") == p[: match.start()].count(")")
        if outside and all(re.fullmatch(r"[a-z0-9]+", o) for o in options):
            before, after = p[: match.start()][-1:], p[match.end() :][:1]
            alone = before == _BORDER and after == _BORDER
            needs.append((set(options), set()) if alone else (set(), set(options)))
        return _UNSURE

    previous = None
    while previous != p:
        previous = p
        p = re.sub(r"\((?:\?:)?[^()]*\)(?:[?*]|\{[^}]*\})", _UNSURE, p)
        p = re.sub(r"\((?:\?:)?([^()|]*\|[^()]*)\)(?![?*{])", choice, p)
        p = re.sub(r"\((?:\?:)?([^()|]*)\)(?![?*{])", r"\1", p)
    if "|" in p:
        return [(set(), {""})]
    p = re.sub(r".(?:[?*]|\{[^}]*\})", _UNSURE, p)
    for match in re.finditer(r"[a-z0-9]+|(?:(?![\x00-\x7f])[^\W_])+" if ascii else r"[^\W_]+", p):
        before, after = p[: match.start()][-1:], p[match.end() :][:1]
        alone = before == _BORDER and after == _BORDER and match[0].isascii()
        needs.append(({match[0]}, set()) if alone else (set(), {match[0]}))
    # Lookups before substring tests; the longest, rarest first.
    needs.sort(key=lambda n: (not n[0], -min(len(w) for w in n[0] | n[1])))
    return needs or [(set(), {""})]


def _starts_at_border(pattern: str) -> bool:
    return bool(re.match(r"(?:\(\?[a-zA-Z]+\))?(?:\(\?-i:)?(?:\\b|\(\?<|[, ])", pattern))


def _ends_at_border(pattern: str) -> bool:
    pattern = re.sub(r"(?:\((?:[^()|]* \|)*[^()|]* \)\?)+$", "", pattern)
    return bool(re.search(r"(?:\\b|[ ,]|\(\?=[^()]*\))\)?$", pattern))


def _glue_pattern(pattern: str, replacement: str) -> str | None:
    """Where this rule would glue its output to a neighbouring word; None if it never can."""
    open_left, open_right = not _starts_at_border(pattern), not _ends_at_border(pattern)
    sides = []
    if open_left and replacement[:1].isalnum():
        sides.append(rf"\w(?:{pattern})")
    if open_right and replacement[-1:].isalnum():
        sides.append(rf"(?:{pattern})\w")
    if open_left and not replacement:
        sides.append(rf"\w(?:{pattern})\w")
    return "|".join(sides) or None


class RuleSet:
    """Ordered rules in one of two pattern dialects.

    ``ascii=True``: word characters and borders are ASCII, as in a browser.
    ``ascii=False``: they follow Unicode.
    """

    def __init__(self, rules: Sequence[Rule], ascii: bool = False):
        self.rules = list(rules)
        self.ascii = ascii

    def pattern(self, pattern: str) -> str:
        if pattern == " +":
            # Runs of one need no rewriting.
            return " {2,}"
        if not self.ascii:
            return unicode_pattern(pattern, ignore_case=True)
        pattern = re.sub(r"(?<=[A-Za-z)])\\b(?= )|(?<= )\\b(?=[A-Za-z])", "", pattern)
        pattern = re.sub(r"^\\b(?=\(?[A-Za-z])", r"(?<!\\w)", pattern)
        pattern = re.sub(r"(?<=[A-Za-z])\\b(?=$|[|)])", r"(?!\\w)", pattern)
        pattern = re.sub(r"\\b", r"(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))", pattern)
        pattern = pattern.replace(r"\s", f"[{SPACE}\\x{{feff}}]")
        return ("(?iu)" if re.search(r"[^\x00-\x7f]", pattern) else "(?i)") + pattern

    def entries(self) -> list[dict]:
        made: list[dict] = []
        for pattern, replacement in self.rules:
            glue = _glue_pattern(pattern, replacement)
            needs = []
            for words, parts in needed_words(pattern, self.ascii):
                wanted = words | parts
                for earlier in made:
                    output = earlier["replacement"].lower()
                    if any(w and w in output for w in wanted):
                        wanted |= set(earlier["needs"][0])
                needs.append(sorted(w.translate(str.maketrans(*FOLDING)) for w in wanted))
            made.append(
                {
                    "pattern": self.pattern(pattern),
                    "replacement": replacement,
                    "needs": needs,
                    "glue": self.pattern(glue) if glue else None,
                }
            )
        return made

    def column(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.entries(), ensure_ascii=False)), RULE_TYPE)

    def usable(self, text: Column) -> Column:
        """The rules whose words occur in ``text``, alone or inside other words."""

        def select(low: Column) -> Column:
            return F.filter(
                self.column(),
                lambda r: F.forall(r["needs"], lambda n: F.exists(n, lambda w: F.contains(low, w))),
            )

        return let(F.lower(F.translate(text, *FOLDING)), select)

    def apply(self, text: Column, guarded: bool = True) -> Column:
        """``text`` after every rule in order; ``guarded=False`` tries them all."""

        def fold(rules: Column, start: Column) -> Column:
            return F.aggregate(
                rules,
                start,
                lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"]),
            )

        if not guarded:
            return fold(self.column(), text)
        if not any(e["glue"] for e in self.entries()):
            return let(text, lambda t: fold(self.usable(t), t))

        def rewrite(t: Column) -> Column:
            def checked(usable: Column) -> Column:
                glued = F.exists(
                    usable,
                    lambda r: r["glue"].isNotNull() & F.rlike(t, F.coalesce(r["glue"], F.lit(""))),
                )
                return F.when(glued, self.column()).otherwise(usable)

            return fold(let(self.usable(t), checked), t)

        return let(text, rewrite)

    def chain(self, text: Column) -> Column:
        """The same for a few rules of which most texts need most: every rule is tried, and its pattern,
        constant in the plan, is compiled once a task, not once a row."""
        for pattern, replacement in self.rules:
            text = F.regexp_replace(text, self.pattern(pattern), replacement)
        return text


# A border of words in ASCII, as a browser has them.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<!\w)", r"(?!\w)"


class LiteralRules(RuleSet):
    """Ordered rules whose patterns are texts between borders of ASCII words."""

    def __init__(self, rules: Sequence[Rule]):
        super().__init__([(whole_words(p), literal_replacement(r)) for p, r in rules], ascii=True)

    def pattern(self, pattern: str) -> str:
        return ("(?i)" if pattern.isascii() else "(?iu)") + pattern


def whole_words(text: str) -> str:
    """A pattern for ``text`` itself, with a border of ASCII words at each end."""
    before = NO_WORD_BEFORE if re.match("[A-Za-z]", text) else BORDER
    after = NO_WORD_AFTER if re.search(r"[A-Za-z]\Z", text) else BORDER
    return before + escape_literal(text) + after


def literal_replacement(text: str) -> str:
    """``text`` as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def escape_literal(text: str) -> str:
    """``text`` as a pattern that matches itself."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)
