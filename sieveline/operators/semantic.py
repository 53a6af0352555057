"""The pluggable language-model step: rule suggestions on the driver, documents in ``mapInPandas``."""

from __future__ import annotations

import json
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import LLMConfig, RuleGenerationConfig, RuleMode, RuleSet, as_mode

# Chat endpoints by provider name (others that speak the same protocol need ``base_url``), and the levels a reply may name.
BASE_URLS = {
    "openai": "https://api.openai.com/v1", "gpt": "https://api.openai.com/v1", "chatgpt": "https://api.openai.com/v1",
    "deepseek": "https://api.deepseek.com", "deepseek-ai": "https://api.deepseek.com",
    "kimi": "https://api.moonshot.cn/v1", "moonshot": "https://api.moonshot.cn/v1", "moonshot-ai": "https://api.moonshot.cn/v1",
    "qwen": "https://dashscope.aliyuncs.com/compatible-mode/v1", "ali": "https://dashscope.aliyuncs.com/compatible-mode/v1",
    "alibabacloud": "https://dashscope.aliyuncs.com/compatible-mode/v1",
}
COMPATIBLE = ("claude", "anthropic")
LEVELS = {"high": "高相关", "boundary": "边界相关", "low": "低相关"}


class SemanticError(RuntimeError):
    """A call or its reply failed."""


def parse_json(reply: str) -> Any:
    """The first JSON value in a reply, with or without a code fence around it."""
    text = reply.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(text)
    except ValueError as e:
        raise SemanticError(f"reply is not JSON: {e}") from e


_PROMPTS = {
    "english": {
        "role": "You prepare screening patterns for a literature search. Topic: {topic}. Field: {domain}.",
        RuleMode.STRICT: "Precision counts most. Each high pattern joins three or four conditions, each boundary pattern two or three; name whatever excludes a record.",
        RuleMode.MODERATE: "Balance precision and recall. High patterns join two or three conditions, boundary patterns one or two.",
        RuleMode.LOOSE: "Recall counts most. A high pattern may be one condition, boundary patterns are single terms; exclude only clear mismatches.",
        "form": "Conditions are regular expressions joined by ' + ', all of which must match title, abstract or keywords. Give synonyms and spelling variants as patterns of their own. "
                "Reply with nothing but a JSON object of the lists high_relevance_patterns, boundary_patterns and low_relevance_patterns.",
        "samples": "Records of the collection:", "feedback": "Change the patterns below as asked. Keep the form.\nPatterns: {rules}\nAsked: {feedback}",
    },
    "chinese": {
        "role": "请为文献检索准备筛选条件。主题：{topic}。领域：{domain}。",
        RuleMode.STRICT: "以精度为先：每条高相关规则由三到四个条件组成，边界规则由两到三个条件组成，并列出排除条件。",
        RuleMode.MODERATE: "兼顾精度与召回：高相关规则两到三个条件，边界规则一到两个条件。",
        RuleMode.LOOSE: "以召回为先：高相关规则可以只有一个条件，边界规则为单个词，只排除明显无关的文献。",
        "form": "条件为正则表达式，用“ + ”连接，须全部在标题、摘要或关键词中出现；同义词和不同写法各写一条。"
                "只回复一个 JSON 对象，含 high_relevance_patterns、boundary_patterns、low_relevance_patterns 三个列表。",
        "samples": "文献示例：", "feedback": "请按要求修改下列规则，格式不变。\n规则：{rules}\n要求：{feedback}",
    },
}


def _wording(language: str) -> dict:
    return _PROMPTS["chinese" if language.lower() in ("chinese", "zh", "中文") else "english"]


def rule_prompt(topic: str, samples: list[str] | None = None, domain: str = "general", language: str = "english",
                rule_mode: RuleMode | str = RuleMode.MODERATE, max_samples: int = 3) -> str:
    """What is asked for rule suggestions, by language and mode, with at most ``max_samples`` records as examples."""
    words = _wording(language)
    shown = [words["samples"], *[f"- {s}" for s in (samples or [])[:max_samples]]] if samples else []
    return "\n".join([words["role"].format(topic=topic, domain=domain), words[as_mode(rule_mode)], words["form"], *shown])


def _number(value: object, default: float) -> float:
    """A number of a reply; anything else counts as ``default``."""
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


class SemanticClient:
    """Prompts and reply handling over ``complete(prompt) -> str``, which a subclass supplies."""

    def __init__(self, config: LLMConfig) -> None:
        self.config = config

    def complete(self, prompt: str) -> str:
        raise NotImplementedError

    def suggest_rules(self, topic: str, samples: list[str] | None = None, domain: str = "general",
                      language: str = "english", rule_mode: RuleMode | str = RuleMode.MODERATE, max_samples: int = 3) -> dict[str, list[str]]:
        return parse_json(self.complete(rule_prompt(topic, samples, domain, language, rule_mode, max_samples)))

    def refine_rules(self, rules: dict[str, list[str]], feedback: str, language: str = "english") -> dict[str, list[str]]:
        return parse_json(self.complete(_wording(language)["feedback"].format(rules=json.dumps(rules, ensure_ascii=False), feedback=feedback)))

    def analyze(self, title: str, abstract: str, topic: str) -> dict[str, Any]:
        return parse_json(self.complete(
            f"Analyse for the topic {topic!r}.\nTitle: {title}\nAbstract: {abstract}\n"
            "Reply as JSON: tags (list), summary, relevance_score (0-1), document_type."))

    def classify(self, title: str, abstract: str, topic: str) -> dict[str, Any]:
        got = parse_json(self.complete(
            f"Is this relevant to {topic!r}?\nTitle: {title}\nAbstract: {abstract}\n"
            "Reply as JSON: judgment (high, boundary or low), confidence (0-1), reason."))
        if not isinstance(got, dict):
            raise SemanticError("reply is no JSON object")
        return {"judgment": LEVELS.get(str(got.get("judgment", "")), LEVELS["boundary"]),
                "confidence": _number(got.get("confidence", 0.5), 0.5), "reason": str(got.get("reason") or "")}

    def classify_batch(self, documents: list[dict[str, str]], topic: str) -> list[dict[str, Any]]:
        listed = "\n".join(f"[{i}] {d.get('title') or ''}: {d.get('abstract') or ''}" for i, d in enumerate(documents))
        got = parse_json(self.complete(f"Classify each for {topic!r}, as a JSON list of judgment, confidence, reason.\n{listed}"))
        if isinstance(got, dict):
            got = next((got[k] for k in ("results", "documents", "data", "items") if isinstance(got.get(k), list)), [])
        if not isinstance(got, list):
            raise SemanticError("reply is no JSON list")
        fill = {"judgment": "boundary", "confidence": 0.5, "reason": ""}
        return [fill | (x if isinstance(x, dict) else {}) for x in [*got, *[{}] * len(documents)][: len(documents)]]


class HttpClient(SemanticClient):
    """Chat completions over HTTPS; the provider's own address applies to every call."""

    def complete(self, prompt: str) -> str:
        c = self.config
        url = (c.base_url or BASE_URLS.get(c.provider.lower(), BASE_URLS["openai"])).rstrip("/") + "/chat/completions"
        body = {"model": c.model, "temperature": c.temperature, "max_tokens": c.max_tokens,
                "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json",
                                                                           "Authorization": f"Bearer {c.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=c.timeout) as reply:  # noqa: S310
                return json.load(reply)["choices"][0]["message"]["content"]
        except Exception as e:
            raise SemanticError(str(e)) from e


class MockClient(SemanticClient):
    """Constant replies, for tests and dry runs."""

    def suggest_rules(self, topic, samples=None, domain="general", language="english", rule_mode=RuleMode.MODERATE, max_samples=3):  # noqa: ANN001, ANN201
        return {"high_relevance_patterns": [topic], "boundary_patterns": ["observational"], "low_relevance_patterns": ["editorial"]}

    def refine_rules(self, rules, feedback, language="english"):  # noqa: ANN001, ANN201
        return rules

    def analyze(self, title, abstract, topic):  # noqa: ANN001, ANN201
        return {"tags": ["mock"], "summary": title or "", "relevance_score": 0.88, "document_type": "article"}

    def classify(self, title, abstract, topic):  # noqa: ANN001, ANN201
        return {"judgment": LEVELS["high"], "confidence": 0.85, "reason": "mock"}

    def classify_batch(self, documents, topic):  # noqa: ANN001, ANN201
        return [{"judgment": "high", "confidence": 0.85, "reason": "mock"} for _ in documents]


def semantic_client(config: LLMConfig) -> SemanticClient:
    provider = config.provider.lower()
    if provider in BASE_URLS or provider in COMPATIBLE:
        return HttpClient(config)
    if provider != "mock":
        warnings.warn(f"unknown provider {config.provider!r}: constant replies are used", stacklevel=2)
    return MockClient(config)


def rules_from(reply: dict[str, list[str]], name: str = "suggested") -> RuleSet:
    return RuleSet(name, "", *[list(reply.get(k, [])) for k in ("high_relevance_patterns", "boundary_patterns", "low_relevance_patterns")])


def generate_rules(client: SemanticClient, topic: str, fallback: list[RuleSet], config: RuleGenerationConfig | None = None, **how: Any) -> list[RuleSet]:
    """Rule sets of a topic; after ``config.max_attempts`` failures the fallback. Each retry waits half as long again."""
    config = config or RuleGenerationConfig()
    how = {"language": config.language, "rule_mode": config.rule_mode, "max_samples": config.max_samples} | how
    for _ in range(config.max_attempts):
        try:
            return [rules_from(client.suggest_rules(topic, **how))]
        except SemanticError:
            client.config.timeout = int(client.config.timeout * 1.5)
    return fallback


def classify_documents(df: DataFrame, make_client: Callable[[], SemanticClient], topic: str, key: str = "record_id",
                       batch: int = 5) -> DataFrame:
    """(key, judgment, confidence, reason) by batches of documents inside each partition.

    A failing batch gives ``boundary`` with confidence 0 and the error as reason, so that a rerun can pick
    it up. Null titles and abstracts count as ''.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out = []
            rows = frame.to_dict("records")
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                try:
                    got = client.classify_batch(part, topic)
                except SemanticError as e:
                    got = [{"judgment": "boundary", "confidence": 0.0, "reason": str(e)}] * len(part)
                out += [(r[key], str(g["judgment"] or "boundary"), _number(g["confidence"], 0.5), str(g["reason"] or "")) for r, g in zip(part, got)]
            yield pd.DataFrame(out, columns=[key, "judgment", "confidence", "reason"])

    kind = df.schema[key].dataType.simpleString()
    return _slim(df, key).mapInPandas(run, f"{key} {kind}, judgment string, confidence double, reason string")


def _slim(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract")])


def classify_boundary(df: DataFrame, make_client: Callable[[], SemanticClient], topic: str, key: str = "record_id") -> DataFrame:
    """(key, judgment, confidence, reason), one call for each document; the judgment is a screening level.

    A failing call gives the boundary level with confidence 0 and the error as reason.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out = []
            for k, title, abstract in zip(frame[key], frame["title"], frame["abstract"]):
                try:
                    got = client.classify(title, abstract, topic)
                except SemanticError as e:
                    got = {"judgment": LEVELS["boundary"], "confidence": 0.0, "reason": str(e)}
                out.append((k, got["judgment"], got["confidence"], got["reason"]))
            yield pd.DataFrame(out, columns=[key, "judgment", "confidence", "reason"])

    return _slim(df, key).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, judgment string, confidence double, reason string")


def analyze_documents(df: DataFrame, make_client: Callable[[], SemanticClient], topic: str, key: str = "record_id") -> DataFrame:
    """(key, tags, summary, relevance_score, document_type); a failing call gives no tags, score 0 and the error as summary."""
    def one(client: SemanticClient, title: str, abstract: str) -> tuple:
        try:
            got = client.analyze(title, abstract, topic)
            if not isinstance(got, dict):
                raise SemanticError("reply is no JSON object")
        except SemanticError as e:
            got = {"summary": str(e)}
        tags = got.get("tags")
        return ([str(t) for t in tags] if isinstance(tags, list) else [], str(got.get("summary") or ""), _number(got.get("relevance_score"), 0.0), str(got.get("document_type") or ""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            got = [(k, *one(client, t, a)) for k, t, a in zip(frame[key], frame["title"], frame["abstract"])]
            yield pd.DataFrame(got, columns=[key, "tags", "summary", "relevance_score", "document_type"])

    kind = df.schema[key].dataType.simpleString()
    return _slim(df, key).mapInPandas(run, f"{key} {kind}, tags array<string>, summary string, relevance_score double, document_type string")
