"""Rule sets, presets, mode templates and their JSON persistence (driver side)."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from enum import Enum


class RuleMode(str, Enum):
    STRICT, MODERATE, LOOSE = "strict", "moderate", "loose"


@dataclass
class RuleSet:
    """Patterns of one topic; ``+`` inside a pattern joins conditions that must all match."""

    name: str = "rules"
    description: str = ""
    high_relevance_patterns: list[str] = field(default_factory=list)
    boundary_patterns: list[str] = field(default_factory=list)
    low_relevance_patterns: list[str] = field(default_factory=list)
    pubtype_patterns: dict[str, list[str]] = field(default_factory=dict)
    weight: float = 1.0
    enabled: bool = True
    rule_mode: RuleMode = RuleMode.MODERATE


@dataclass
class LLMConfig:
    provider: str = "mock"
    api_key: str = ""
    base_url: str = ""
    model: str = ""
    timeout: int = 120
    temperature: float = 0.3
    max_tokens: int = 2000
    max_retries: int = 3
    enabled: bool = False


@dataclass
class ScreeningConfig:
    """What the screening pipeline needs; the defaults are those of the stages themselves."""

    seed_texts: list[str] = field(default_factory=list)
    rule_mode: RuleMode | str = RuleMode.MODERATE
    review_threshold: float = 0.5
    tfidf_low: float | None = 0.02
    tfidf_high: float | None = 0.3
    rank_percentile: float = 25.0
    rule_weight: float = 0.4
    tfidf_weight: float = 0.6
    max_features: int = 8000
    stop_words: list[str] | None = None  # None: Spark's English list
    direct_high: bool = True
    direct_low: bool = True


@dataclass
class ProjectConfig:
    research_topic: str = ""
    domain: str = "general"
    rule_sets: list[RuleSet] = field(default_factory=list)
    screening: ScreeningConfig = field(default_factory=ScreeningConfig)


@dataclass
class RuleGenerationConfig:
    language: str = "english"
    rule_mode: RuleMode = RuleMode.MODERATE
    max_attempts: int = 4
    max_samples: int = 3


# Patterns of publication types and of the presets by field of research.
DEFAULT_PUBTYPE_PATTERNS = {
    "letter": [r"\bletter\b", r"\bcorrespondence\b"],
    "reply": [r"\breply\b", r"\bresponse\s*to\b", r"\bin\s*reply\b"],
    "comment": [r"\bcomment(?:ary)?\b", r"\beditorial\b"],
    "protocol": [r"\bprotocol\b", r"\bstudy\s*design\b", r"\btrial\s*registr"],
    "review": [r"systematic\s*review", r"meta[\s-]*analy", r"\bscoping\s*review\b"],
}
PRESET_PATTERNS = {
    "default_rules": ([], [], []),
    "medical_research": (
        [r"clinical\s*trial", r"randomized", r"placebo\s*controlled", r"longitudinal", r"prospective", r"cohort",
         r"meta[-\s]*analysis", r"systematic\s*review"],
        [r"case\s*control", r"cross[-\s]*sectional", r"observational", r"retrospective"],
        [r"animal\s*study", r"in\s*vitro", r"review\s*article", r"commentary", r"editorial", r"letter",
         r"correspondence"],
    ),
    "basic_science": (
        [r"mechanism", r"pathway", r"molecular", r"cellular", r"genetic", r"proteomic", r"in\s*vitro", r"in\s*vivo"],
        [r"computational", r"bioinformatic", r"theoretical", r"model"],
        [r"clinical\s*trial", r"human\s*study", r"case\s*report", r"clinical\s*practice"],
    ),
    "clinical_research": (
        [r"patient", r"clinical", r"treatment", r"therapy", r"diagnosis", r"prognosis", r"outcome", r"survival"],
        [r"case\s*series", r"case\s*report", r"retrospective", r"chart\s*review"],
        [r"animal\s*model", r"in\s*vitro", r"basic\s*science", r"preclinical"],
    ),
}
PRESET_NAMES = {"default": "default_rules", "medical": "medical_research", "clinical": "clinical_research",
                "basic": "basic_science"}
DOMAIN_PRESETS = {"medicine": "medical", "medical": "medical", "biology": "basic", "basic_science": "basic",
                  "clinical": "clinical", "clinical_research": "clinical"}

# The templates of the three rule modes (high, boundary, low, publication types).
MODE_PATTERNS = {
    RuleMode.STRICT: (
        ["clinical trial + randomized + controlled + efficacy",
         "systematic review + meta-analysis + evidence + synthesis",
         "cohort study + prospective + longitudinal + follow-up",
         "intervention + randomized + double-blind + placebo",
         "randomized controlled trial + primary outcome",
         "systematic review + Cochrane + meta-analysis",
         "prospective cohort + incidence + risk factors",
         "double-blind + placebo-controlled + randomized"],
        ["clinical study + observational", "retrospective cohort + analysis", "cross-sectional study + prevalence",
         "case-control study + risk factors", "pilot study + feasibility", "quasi-experimental + intervention"],
        ["case report + single", "letter + editor + correspondence", "review + narrative + opinion",
         "animal study + in vivo", "in vitro + cell culture", "protocol + study design",
         "abstract only + conference", "commentary + editorial + perspective"],
        {"original_research": ["original article", "research article", "original research", "full text",
                               "full-length article"],
         "clinical_trial": ["randomized controlled trial", "clinical trial", "RCT", "intervention study",
                            "therapeutic trial"],
         "systematic_review": ["systematic review", "meta-analysis", "Cochrane review", "evidence synthesis",
                               "umbrella review"],
         "cohort_study": ["prospective cohort", "retrospective cohort", "cohort study", "longitudinal study",
                          "follow-up study"]},
    ),
    RuleMode.MODERATE: (
        ["randomized controlled trial + primary", "systematic review + meta-analysis",
         "prospective cohort + risk factors", "clinical trial + efficacy + safety", "randomized + controlled",
         "systematic review + evidence", "cohort study + longitudinal", "intervention + outcome",
         "double-blind + placebo", "meta-analysis + pooled", "prospective + incidence",
         "controlled trial + intervention"],
        ["observational study + analysis", "cross-sectional + prevalence", "case-control + association",
         "pilot study + preliminary", "feasibility study + intervention", "multicenter study", "population-based",
         "community-based", "registry-based"],
        ["case report", "letter", "editorial", "commentary", "narrative review", "animal study", "in vitro",
         "protocol", "abstract", "conference"],
        {"original_research": ["original article", "research article", "full text"],
         "clinical_trial": ["randomized controlled trial", "clinical trial", "RCT", "controlled trial",
                            "intervention study"],
         "systematic_review": ["systematic review", "meta-analysis"],
         "observational_study": ["cohort study", "case-control study", "cross-sectional study",
                                 "observational study"],
         "review": ["review article", "comprehensive review"]},
    ),
    RuleMode.LOOSE: (
        ["randomized + trial", "systematic review", "meta-analysis", "cohort study", "clinical trial",
         "controlled study", "intervention study", "prospective study", "longitudinal study", "comparative study",
         "randomized", "controlled trial", "evidence-based", "population study", "epidemiological study"],
        ["observational", "descriptive study", "analytical study", "cross-sectional", "prevalence study", "survey",
         "questionnaire", "interview study", "focus group", "qualitative study"],
        ["case report only", "letter to editor", "editorial comment", "opinion piece", "animal model",
         "in vitro only", "conference abstract only"],
        {"research": ["original", "research", "study", "trial", "analysis", "investigation"],
         "review": ["review", "systematic", "meta-analysis"],
         "clinical": ["clinical", "therapeutic", "treatment", "intervention", "efficacy"]},
    ),
}
# Names and quality targets of the modes.
MODE_INFO = {
    RuleMode.STRICT: {"zh": ("严格模式", "严格"), "en": ("Strict Mode", "Strict"), "precision": "≥95%",
                      "recall": "60-70%", "use": "systematic reviews that need high confidence"},
    RuleMode.MODERATE: {"zh": ("中等模式", "中等"), "en": ("Moderate Mode", "Moderate"), "precision": "80-90%",
                        "recall": "75-85%", "use": "most screenings"},
    RuleMode.LOOSE: {"zh": ("宽松模式", "宽松"), "en": ("Loose Mode", "Loose"), "precision": "60-75%",
                     "recall": "≥90%", "use": "first screenings that must miss nothing"},
}


def preset_rule_set(name: str) -> RuleSet:
    """A preset by its short name; an unknown name gives the default, which has no patterns."""
    full = PRESET_NAMES.get(name, "default_rules")
    high, boundary, low = PRESET_PATTERNS[full]
    return RuleSet(full, f"preset {full}", list(high), list(boundary), list(low),
                   {k: list(v) for k, v in DEFAULT_PUBTYPE_PATTERNS.items()})


def list_presets() -> list[str]:
    return list(PRESET_NAMES)


def preset_rules(domain: str = "general") -> list[RuleSet]:
    """The presets of a research domain; domains without a template leave every record unclear."""
    return [preset_rule_set(DOMAIN_PRESETS.get(domain, "default"))]


def as_mode(mode: RuleMode | str) -> RuleMode:
    try:
        return RuleMode(mode)
    except ValueError:
        return RuleMode.MODERATE


def mode_rules(mode: RuleMode | str = RuleMode.MODERATE, topic: str = "general") -> RuleSet:
    """The template of a rule mode; an unknown mode gives the moderate one."""
    mode = as_mode(mode)
    high, boundary, low, kinds = MODE_PATTERNS[mode]
    return RuleSet(f"{MODE_INFO[mode]['zh'][0]}规则集 - {topic}", f"template of the {mode.value} mode", list(high),
                   list(boundary), list(low), {k: list(v) for k, v in kinds.items()}, rule_mode=mode)


#: What a mode stands for, in own words: (summary, high rules, boundary rules, what to expect), Chinese and English.
MODE_TEXTS = {
    RuleMode.STRICT: {
        "zh": ("以精度为先", "三到四个条件同时成立", "两到三个条件同时成立", ("很少误收", "会漏掉表述不全的文献", "高相关须多条件并存", "边界同样须多条件", "低相关直接排除")),
        "en": ("precision first", "three or four conditions at once", "two or three conditions at once",
               ("few false hits", "misses records with terse abstracts", "high needs several conditions", "boundary does as well", "low is excluded at once"))},
    RuleMode.MODERATE: {
        "zh": ("精度与召回兼顾", "两到三个条件同时成立", "一到两个条件", ("误收与漏检相当", "高相关条件适中", "边界较宽", "适用面广", "默认模式")),
        "en": ("precision and recall in balance", "two or three conditions at once", "one or two conditions",
               ("false hits and misses alike", "moderate conditions for high", "a wider boundary", "fits most topics", "the default"))},
    RuleMode.LOOSE: {
        "zh": ("以召回为先", "一到两个条件即可", "单个条件即可", ("很少漏检", "需要较多人工复核", "高相关可为单条件", "边界很宽", "只排除明显无关者")),
        "en": ("recall first", "one or two conditions", "a single condition",
               ("few misses", "more records to review by hand", "one condition may make high", "a very wide boundary", "only clear mismatches are excluded"))},
}
_TABLE = {"zh": ("指标", "精度目标", "召回目标", "高相关规则", "边界规则", "适用场景"), "en": ("measure", "precision", "recall", "high rules", "boundary rules", "use")}


def mode_description(mode: RuleMode | str, language: str = "chinese") -> dict[str, str | list[str]]:
    """Name, targets, rule complexity, use and characteristics of a mode; an unknown mode is the moderate one."""
    mode, lang = as_mode(mode), "zh" if language == "chinese" else "en"
    info, (summary, high, boundary, traits) = MODE_INFO[mode], MODE_TEXTS[mode][lang]
    name, short = info[lang]
    return {"name": name, "short_name": short, "description": summary, "precision_target": info["precision"], "recall_target": info["recall"],
            "use_case": info["use"], "high_rule_complexity": high, "boundary_rule_complexity": boundary, "characteristics": list(traits)}


def mode_comparison(language: str = "chinese") -> list[dict[str, str | list[str]]]:
    return [{"mode": m.value} | mode_description(m, language) for m in RuleMode]


def mode_table(language: str = "chinese") -> str:
    """The modes side by side as a Markdown table: a row per measure."""
    modes = mode_comparison(language)
    keys = ("precision_target", "recall_target", "high_rule_complexity", "boundary_rule_complexity", "use_case")
    head, *labels = _TABLE["zh" if language == "chinese" else "en"]
    rows = [[head, *[m["name"] for m in modes]], ["-"] * (len(modes) + 1), *[[label, *[m[k] for m in modes]] for label, k in zip(labels, keys)]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def example_rule_set() -> RuleSet:
    """A small rule set that shows joined conditions."""
    # The patterns of the example.
    return RuleSet(
        "骨量减少速率组合规则", "conditions joined by +",
        ["骨量+年变化率", "骨量+队列研究", "骨密度+纵向研究", "bone mass+annual change", "BMD+longitudinal"],
        ["骨量+横断面", "骨密度+横断面"],
        ["骨量+动物实验", "骨密度+体外研究", "bone+in vitro"],
    )


def save_json(config: LLMConfig | ProjectConfig, path: str) -> None:
    """Write a configuration; API keys are never written."""
    data = asdict(config)
    data.pop("api_key", None)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(data, out, ensure_ascii=False, indent=2)


def load_llm_config(path: str) -> LLMConfig | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return LLMConfig(**{k: v for k, v in data.items() if k in LLMConfig.__dataclass_fields__})


def load_project_config(path: str) -> ProjectConfig | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rules = [RuleSet(**{**r, "rule_mode": as_mode(r.get("rule_mode", "moderate"))}) for r in data.get("rule_sets", [])]
    screening = ScreeningConfig(**data.get("screening", {}))
    return ProjectConfig(data.get("research_topic", ""), data.get("domain", "general"), rules, screening)
