"""Rules compiled into columns: hits, tiers, scores and the direct judgment."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.config import RuleMode, RuleSet, as_mode
from sieveline.functions.regexes import matches
from sieveline.functions.text import text_blob

# The labels of the screening stages.
HIGH, BOUNDARY, LOW = "高相关", "边界相关", "低相关"
DIRECT = {
    "high": (HIGH, "rule_pattern_matched", "规则层直判：命中高相关特征", "rule_direct_high"),
    "low": (LOW, "not_applicable", "规则层直判：命中低相关特征", "rule_direct_low"),
}
REVIEW_BOUNDARY = "边界文献：需要进一步评估"
REVIEW_SINGLE = "宽松模式：单条件匹配，建议复核"
REVIEW_PUBTYPE = "宽松模式：综述/信件/评论类文献，建议复核"
REVIEW_TYPES = ("review", "letter", "comment", "editorial")

JUDGMENT = ("screening_level", "evidence_type", "reason", "screening_method", "needs_review", "review_reason")


@dataclass(frozen=True)
class CombinedRule:
    """Conditions that must all match."""

    name: str
    conditions: tuple[str, ...]
    weight: float

    @property
    def points(self) -> float:
        return len(self.conditions) * self.weight

    @property
    def label(self) -> str:
        return f"{self.name}({'+'.join(self.conditions)})"


def combined_rules(rules: RuleSet) -> dict[str, list[CombinedRule]]:
    """The rules of a set by kind. ``+`` splits everywhere, and an empty piece always matches and counts."""
    out: dict[str, list[CombinedRule]] = {}
    for kind, patterns, factor in (("high", rules.high_relevance_patterns, 1.0),
                                   ("boundary", rules.boundary_patterns, 0.5),
                                   ("low", rules.low_relevance_patterns, 1.0)):
        out[kind] = []
        for i, pattern in enumerate(patterns):
            parts = tuple(p.strip() for p in pattern.split("+"))
            if "" in parts and len(parts) > 1:
                warnings.warn(f"{pattern!r} has an empty condition, which matches every text", stacklevel=2)
            shape = "combined" if len(parts) > 1 else "single"
            out[kind].append(CombinedRule(f"{kind}_{shape}_{i}", parts, rules.weight * factor))
    return out


def match_any(text: Column, patterns: list[str]) -> Column:
    """array<string> of the patterns that match."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(p)) for p in patterns])) if patterns \
        else F.array().cast("array<string>")


def rule_screening(df: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """Add the hits, publication types, tier and score of the enabled rule sets.

    Every distinct condition is one boolean column that all rules share. Row-local: no shuffle,
    no UDF. Null texts count as empty.
    """
    enabled = [r for r in rule_sets if r.enabled]
    compiled = [combined_rules(r) for r in enabled]
    wanted = [c for rules in compiled for kind in rules.values() for r in kind for c in r.conditions]
    wanted += [p for r in enabled for ps in r.pubtype_patterns.values() for p in ps]
    number = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys(wanted))}
    text = text_blob(F.col("title"), F.col("abstract"), F.col("keywords"))
    base = df.withColumn("_text", text).withColumns({n: matches(F.col("_text"), c) for c, n in number.items()})

    def total(kind: str) -> Column:
        parts = [F.when(reduce(lambda a, b: a & b, [F.col(number[c]) for c in r.conditions]), F.lit(float(r.points)))
                 .otherwise(0.0) for rules in compiled for r in rules[kind]]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)

    def hits(kind: str) -> Column:
        parts = [F.when(reduce(lambda a, b: a & b, [F.col(number[c]) for c in r.conditions]), F.lit(r.label))
                 for rules in compiled for r in rules[kind]]
        return F.concat_ws("; ", *parts) if parts else F.lit("")

    types = [F.when(reduce(lambda a, b: a | b, [F.col(number[p]) for p in ps]), F.lit(t))
             for r in enabled for t, ps in r.pubtype_patterns.items() if ps]
    pubtype = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*types)))), "; ") if types else F.lit("")
    scored = base.withColumns({"_h": total("high"), "_b": total("boundary"), "_l": total("low")})
    h, b, low = F.col("_h"), F.col("_b"), F.col("_l")
    tier = (F.when((h > 0) & (low == 0), "rule_high").when((b > 0) & (low == 0), "rule_boundary")
            .when((low > 0) & (h == 0) & (b == 0), "rule_low").otherwise("rule_unclear"))
    return scored.withColumns({
        "rule_high_hits": hits("high"), "rule_boundary_hits": hits("boundary"), "rule_low_hits": hits("low"),
        "rule_pubtype": pubtype, "rule_tier": tier,
    }).withColumn("rule_score", F.when(F.col("rule_tier") == "rule_high", h)
                  .when(F.col("rule_tier") == "rule_boundary", b * 0.5)
                  .when(F.col("rule_tier") == "rule_low", -low).otherwise(F.lit(0.0))
                  ).drop("_text", "_h", "_b", "_l", *number.values())


def undecided(level: str = "screening_level") -> Column:
    return F.col(level).isNull() | (F.col(level) == "")


def set_judgment(df: DataFrame, where: Column, label: tuple[str, str, str, str]) -> DataFrame:
    """Write a level, evidence type, reason and method where the condition holds."""
    return df.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in zip(JUDGMENT[:4], label)})


def rule_judgment(df: DataFrame, direct_high: bool = True, direct_low: bool = True,
                  rule_mode: RuleMode | str = RuleMode.MODERATE, review_threshold: float = 0.5,
                  fresh: bool = True) -> DataFrame:
    """Label what the rules decide and flag what a person should look at.

    ``fresh`` starts from empty labels; with ``fresh=False`` labels that are there stay unless a rule
    decides. Boundary rows are flagged only. The loose mode also flags weak single matches and, last
    and therefore winning, reviews, letters and comments.
    """
    start = {c: F.lit("") for c in (*JUDGMENT[:4], "review_reason")} | {"needs_review": F.lit(False)}
    df = df.withColumns({c: v for c, v in start.items() if fresh or c not in df.columns})
    flags = []
    if direct_high and as_mode(rule_mode) is RuleMode.LOOSE:
        high = F.col("rule_tier") == "rule_high"
        flags.append((high & (F.col("rule_score") < 2 * review_threshold), REVIEW_SINGLE))
        flags.append((high & F.lower("rule_pubtype").rlike("|".join(REVIEW_TYPES)), REVIEW_PUBTYPE))
    flags.append((F.col("rule_tier") == "rule_boundary", REVIEW_BOUNDARY))
    if direct_high:
        df = set_judgment(df, F.col("rule_tier") == "rule_high", DIRECT["high"])
    if direct_low:
        df = set_judgment(df, F.col("rule_tier") == "rule_low", DIRECT["low"])
    for where, why in flags:
        df = df.withColumns({"needs_review": F.when(where, F.lit(True)).otherwise(F.col("needs_review")),
                             "review_reason": F.when(where, F.lit(why)).otherwise(F.col("review_reason"))})
    return df
