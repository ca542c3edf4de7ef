"""Prompts of generation, counterfactuals and judgements as column expressions.

Their wording is data: hashes of prompts are stored with candidates, so it must stay as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import compact_text

# Characters of a text that a prompt may hold, by task, and of other parts.
LIMITS = {"news_topic_classification": 2200, "summarization": 3200}
OTHER_LIMIT = 1200
SUMMARY_LIMIT, COUNTERFACTUAL_LIMIT, JUDGED_LIMIT = 900, 1400, 2200

# The wording of the prompts.
CLASSIFY = (
    "Task: {task}\nLanguage: {language}\nAllowed labels: {labels}\nSeed label: {label}\nSeed text excerpt:\n{text}\n\n"
    "Generate {n} new examples in the same language and label. {length} "
    "Do not copy the seed text or held-out text. Do not translate an English template. "
    "Return valid JSON only, with no Markdown fences or commentary. "
    'Return JSON list: [{"text": str, "label": str, "confidence": float}].'
)
NEWS_LENGTH = "Each generated text should be a concise news item of 60-120 words."
SHORT_LENGTH = "Each generated text should be concise and natural, usually under 60 words."
TAGS = (
    "Task: named entity recognition\nLanguage: {language}\nSeed tokens: {tokens}\nSeed BIO tags: {tags}\n"
    "Generate {n} plausible token sequences with BIO tags over PER, ORG, LOC, DATE. "
    'Return JSON list: [{"text": str, "tokens": [str], "tags": [str], "confidence": float}].'
)
SUMMARIZE = (
    "Task: summarization\nLanguage: {language}\nSource article excerpt:\n{text}\nSeed summary:\n{summary}\n\n"
    "Generate {n} source-summary training pairs in the same language. "
    "Return valid JSON only, with no Markdown fences or commentary. "
    'Return JSON list: [{"text": source, "summary": str, "label": "summary", "confidence": float}].'
)
JUDGE_SYSTEM = "You are an expert evaluator for low-resource NLP synthetic data. Judge the candidate conservatively. Return strict JSON only, with numeric scores in [0,1]."
JUDGE_USER = (
    "Task: {task}\nLanguage code: {language}\nCandidate label/output: {label}\nCandidate text excerpt:\n{text}\n\n"
    "Counterfactual expected label/output: {cf_label}\nCounterfactual text excerpt:\n{cf_text}\n\n"
    "Assess these fields:\n"
    "- label_correctness: candidate matches its label or structured output.\n"
    "- fluency: language is grammatical/natural.\n"
    "- cultural_plausibility: content is plausible for the target language/community; use 0.5 if unsure.\n"
    "- leakage_suspicion: likely copied from held-out data or a known article/benchmark item.\n"
    "- counterfactual_validity: counterfactual minimally changes a task-relevant variable and should change label/output.\n"
    "- quality_score: overall suitability for fine-tuning.\n\n"
    "Return exactly valid JSON only, with no Markdown fences or commentary:\n"
    '{"label_correctness": float, "fluency": float, "cultural_plausibility": float, '
    '"leakage_suspicion": float, "counterfactual_validity": float, "quality_score": float, "rationale": string}'
)


def filled(template: str, **values: Column | str) -> Column:
    """A template with columns in its {places}; null values read None. Braces that hold no name of a value stay."""
    import re

    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    whole = [F.lit(x) if i % 2 == 0 else F.coalesce(F.lit(values[x]) if isinstance(values[x], str) else values[x].cast("string"), F.lit("None")) for i, x in enumerate(parts)]
    return F.concat(*whole)


def prompt_limit(task: Column) -> Column:
    """Characters of a text that the prompt of a task may hold."""
    out = F.lit(OTHER_LIMIT)
    for name, n in LIMITS.items():
        out = F.when(task == name, n).otherwise(out)
    return out


def listed(words: Column) -> Column:
    """A list as a prompt shows it: quoted words in brackets."""
    return F.when(words.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]")))


def generation_prompt(task: Column, language: Column, label: Column, text: Column, labels: Column, n: int = 1, summary: Column | None = None, tokens: Column | None = None, tags: Column | None = None) -> Column:
    """The prompt of a seed by its task; ``labels`` is the array of allowed labels, empty for none."""
    none = F.lit(None).cast("string")
    allowed = F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("task-specific output")
    body = compact_text(text, prompt_limit(task))
    length = F.when(task == "news_topic_classification", NEWS_LENGTH).otherwise(SHORT_LENGTH)
    classify = filled(CLASSIFY, task=task, language=language, labels=allowed, label=label, text=body, n=str(n), length=length)
    tagged = filled(TAGS, language=language, tokens=listed(tokens) if tokens is not None else none, tags=listed(tags) if tags is not None else none, n=str(n))
    shorten = filled(SUMMARIZE, language=language, text=body, summary=compact_text(summary if summary is not None else none, SUMMARY_LIMIT), n=str(n))
    return F.when(task.isin("news_topic_classification", "sentiment_classification", "intent_slot_filling"), classify).when(task == "named_entity_recognition", tagged).otherwise(shorten)


def judge_prompt(task: Column, language: Column, label: Column, text: Column, cf_label: Column, cf_text: Column) -> Column:
    return filled(JUDGE_USER, task=task, language=language, label=label, text=compact_text(text, JUDGED_LIMIT), cf_label=cf_label, cf_text=compact_text(cf_text, COUNTERFACTUAL_LIMIT))
