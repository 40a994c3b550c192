"""Annotators without models: one by simple rules, one without coreference, one that looks its results up."""

from __future__ import annotations

import re

from .base import Parse, register

_TOKEN = re.compile(r"\w+|[^\w\s]")
_PRONOUN = frozenset("he she it they him her them his hers its their i you we me us my your our".split())


@register("rules")
class RuleAnnotator:
    """Capitalised runs are entities; equal ones are one cluster, and a pronoun joins the nearest before it.

    The tree is a chain: every token hangs on the one before. It stands in for a parser in tests
    and claims no more.
    """

    def parse(self, text: str) -> Parse:
        tokens, entities = [], []
        for i, m in enumerate(_TOKEN.finditer(text)):
            word = m[0]
            tag = "PRP" if word.lower() in _PRONOUN else "NNP" if word[:1].isupper() and i else "NN" if word.isalpha() else "."
            tokens.append(
                {"i": i, "text": word, "lemma": word.lower(), "pos": tag, "tag": tag, "dep": "root" if i == 0 else "dep", "head": max(i - 1, 0), "ent_type": "", "ent_iob": "O", "char_start": m.start(), "char_end": m.end()}
            )
        for a, b in self._runs(tokens):
            for k in range(a, b):
                tokens[k]["ent_type"], tokens[k]["ent_iob"] = "ENT", "B" if k == a else "I"
            start, end = tokens[a]["char_start"], tokens[b - 1]["char_end"]
            entities.append({"text": text[start:end], "label": "ENT", "char_start": start, "char_end": end, "token_start": a, "token_end": b, "head_token": a, "grammatical_role": tokens[a]["dep"]})
        return Parse(tokens, entities)

    @staticmethod
    def _runs(tokens: list[dict]) -> list[tuple[int, int]]:
        out, a = [], None
        for i, t in enumerate([*tokens, None]):
            name = t is not None and t["text"][:1].isupper() and t["text"].lower() not in _PRONOUN
            if name and a is None:
                a = i
            elif not name and a is not None:
                out.append((a, i))
                a = None
        return out

    def clusters(self, text: str) -> list[list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {}
        spans = [(e["char_start"], e["char_end"], e["text"].lower()) for e in self.parse(text).entities]
        spans += [(m.start(), m.end(), "") for m in _TOKEN.finditer(text) if m[0].lower() in _PRONOUN]
        last = ""
        for start, end, name in sorted(spans):
            last = name or last
            if last:
                found.setdefault(last, []).append((start, end))
        return list(found.values())


@register("none")
class NoCoreference(RuleAnnotator):
    """Entities and tokens only."""

    def clusters(self, text: str) -> list[list[tuple[int, int]]]:
        return []


@register("precomputed")
class Precomputed(RuleAnnotator):
    """Results of a model that ran elsewhere, by text: {text: (tokens, entities, clusters)}; other texts have none."""

    def __init__(self, results: dict[str, tuple] | None = None):
        self.results = results or {}

    def parse(self, text: str) -> Parse:
        tokens, entities, _ = self.results.get(text, ([], [], []))
        return Parse(tokens, entities)

    def clusters(self, text: str) -> list[list[tuple[int, int]]]:
        return self.results.get(text, ([], [], []))[2]
