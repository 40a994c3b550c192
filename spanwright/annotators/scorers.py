"""Scorers of stimuli: how likely each subword is behind the ones before it."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Protocol

#: What a token begins with if it begins a word (fixed value of byte-level vocabularies).
WORD_MARK = "Ġ"


class Scorer(Protocol):
    def pieces(self, words: list[str]) -> list[int]:
        """Subwords of each word, as it stands behind a space."""
        ...

    def scores(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        """Tokens of each text with their base-2 log probabilities; a token with the mark begins a word."""
        ...


def last_word_bits(scores: list[tuple[str, float]]) -> float:
    """Surprisal of the last word of a stimulus: that of its tokens from the last mark on (of all, without one)."""
    first = max((i for i, (token, _) in enumerate(scores) if token.startswith(WORD_MARK)), default=0)
    return -sum(score for _, score in scores[first:])


class CountScorer:
    """Words by their counts, with one more for each and for all others together; a word is one piece, whatever stands before it."""

    def __init__(self, counts: dict[str, float]):
        self.counts, self.total = counts, sum(counts.values()) + len(counts) + 1

    @classmethod
    def from_pairs(cls, pairs: Iterable[tuple[str, float]]) -> CountScorer:
        counts: dict[str, float] = {}
        for word, n in pairs:
            counts[word] = counts.get(word, 0.0) + n
        return cls(counts)

    def pieces(self, words: list[str]) -> list[int]:
        return [1] * len(words)

    def scores(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        return [[(WORD_MARK + w, math.log2((self.counts.get(w, 0.0) + 1) / self.total)) for w in t.split(" ")] for t in texts]


class LanguageModel:
    """An incremental language model of the minicons library, by name or path."""

    def __init__(self, name: str = "openai-community/gpt2", device: str = "cpu"):
        from minicons import scorer

        self.model = scorer.IncrementalLMScorer(model=name, device=device)

    def pieces(self, words: list[str]) -> list[int]:
        return [len(self.model.tokenizer.encode(f" {w}")) for w in words]

    def scores(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        begin = self.model.tokenizer.bos_token or ""
        found = self.model.token_score(batch=[f"{begin} {t}" for t in texts], base_two=True, bow_correction=True)
        return [[(t, float(x)) for t, x in one[bool(begin) :]] for one in found]
