"""Language of a text by its commonest small words, and answers in the asker's language.

An offline stand-in: no library and no model; the translator is whatever the caller gives.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .verify import same_figures

#: Frequent small words by language. Fixed values.
SMALL = {
    "en": "the of and to in is that for with was are by on it as from".split(),
    "fr": "le la les des du et une un en que qui dans pour sur est au".split(),
    "de": "der die das und in den von zu mit sich auf für ist nicht ein dem".split(),
    "es": "el la los las de y en que del se por con para una su al".split(),
}
NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def detect_language(text: str, fallback: str = "en") -> str:
    """M1"""
    words = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in v for w in words) for k, v in ((k, set(v)) for k, v in SMALL.items())}
    best = max(score, key=lambda k: (score[k], k == fallback))
    return best if score[best] else fallback


def language_column(text: Column, fallback: str = "en") -> Column:
    """M1 for columns: the language with the most small words, ties in the order en, fr, de, es."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")

    def hits(small: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*small)))

    counts = [hits(small) for small in SMALL.values()]
    best = F.greatest(*counts)
    out = F.lit(fallback)
    for k, c in reversed(list(zip(SMALL, counts, strict=True))):
        out = F.when((c == best) & (best > 0), k).otherwise(out)
    return out


class Translator(Protocol):
    def translate(self, text: str, to: str) -> str: ...


class MultilingualAgent:
    """M2-M4: questions into English, answers back, with their figures held equal."""

    def __init__(self, agent, translator: Translator) -> None:
        self.agent, self.translator = agent, translator

    def run(self, question: str):
        language = detect_language(question)
        result = self.agent.run(question if language == "en" else self.translator.translate(question, "en"))
        if language != "en":
            back = self.translator.translate(result.answer, language)
            lost = same_figures(result.answer, back)
            result.warnings += [f"figures differ after translation: {sorted(lost)}"] if lost else []
            result.answer = back if not lost else result.answer
        return result
