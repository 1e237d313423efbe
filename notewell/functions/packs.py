"""Rules as data: user-supplied packs that compile to Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m

# Beyond this many labels one expression per label is the wrong plan: use
# operators.joins.tag_by_lexicon_table, which explodes tokens and joins.
MAX_INLINE_LABELS = 200


@dataclass(frozen=True)
class RulePack:
    """Labels with the patterns that imply them, in priority order."""

    name: str
    labels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    flags: str = m.FLAGS

    def __post_init__(self) -> None:
        if len(self.labels) > MAX_INLINE_LABELS:
            raise ValueError(
                f"pack {self.name!r} has {len(self.labels)} labels; "
                f"use a lexicon table above {MAX_INLINE_LABELS}"
            )

    @classmethod
    def from_keywords(cls, name: str, keywords: Mapping[str, Sequence[str]]) -> "RulePack":
        """Keyword dictionary: literal words with alphanumeric boundaries.

        A keyword listed under several tags belongs to the last one.
        """
        owner: dict[str, str] = {}
        for tag, words in keywords.items():
            for word in words:
                cleaned = str(word).strip().lower()
                if cleaned:
                    owner[cleaned] = tag
        grouped: dict[str, list[str]] = {}
        for word, tag in owner.items():
            grouped.setdefault(tag, []).append(word)
        labels = {
            tag: (r"(?<![\p{L}\p{N}])(?:" + "|".join(quote(w) for w in words) + r")(?![\p{L}\p{N}])",)
            for tag, words in grouped.items()
        }
        return cls(name, labels)

    def matching(self, text: Column) -> Column:
        return m.labels_matching(text, self.labels, self.flags)

    def first(self, text: Column, default: str | None = None) -> Column:
        return m.first_matching(text, self.labels.items(), default, self.flags)

    def has(self, text: Column, label: str) -> Column:
        return m.any_match(text, self.labels[label], self.flags)

    def merged(self, other: "RulePack") -> "RulePack":
        return RulePack(f"{self.name}+{other.name}", {**self.labels, **other.labels}, self.flags)


def quote(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return "".join("\\" + c if c in r".^$*+?()[]{}|\-/&~#" else c for c in literal)


@dataclass(frozen=True)
class AmountRule:
    """A pattern plus the way its groups become an amount.

    kinds: ``plain`` g1, ``thousands`` g1*1000, ``mean`` (g1+g2)//2,
    ``mean_thousands`` (g1+g2)*500.
    """

    kind: str
    pattern: str

    def amount(self, text: Column) -> Column:
        regex = m.FLAGS + self.pattern
        first = F.regexp_extract(text, regex, 1).try_cast("bigint")
        if self.kind == "plain":
            return first
        if self.kind == "thousands":
            return first * 1000
        second = F.regexp_extract(text, regex, 2).try_cast("bigint")
        if self.kind == "mean":
            return F.floor((first + second) / 2).cast("bigint")
        if self.kind == "mean_thousands":
            return (first + second) * 500
        raise ValueError(f"unknown amount kind {self.kind!r}")


AMOUNT_RULES = tuple(AmountRule(kind, pattern) for kind, pattern in fv.AMOUNT_RULES)


def first_amount(text: Column, rules: Sequence[AmountRule] = AMOUNT_RULES) -> Column:
    """The amount of the first rule that matches, else null."""
    return F.coalesce(*[rule.amount(text) for rule in rules])


RELATIONS = RulePack("relations", fv.RELATIONS)
COMPANIONS = RulePack("companions", fv.COMPANIONS)
ALLERGIES = RulePack("allergies", fv.ALLERGIES)
DIETS = RulePack("diets", fv.DIETS)
SEVERITIES = RulePack("severities", fv.SEVERITIES)
OCCASIONS = RulePack("occasions", fv.OCCASIONS)
COLORS = RulePack("colors", fv.COLORS)
MATERIALS = RulePack("materials", fv.MATERIALS)
USAGES = RulePack("usages", fv.USAGES)
EXTRA_KEYWORDS = RulePack.from_keywords("extra_keywords", fv.EXTRA_KEYWORDS)
NO_PRODUCT_NAMES = RulePack("product_names", {})
