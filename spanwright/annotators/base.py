"""The interface of annotators, and a registry by name.

An annotator is built once per Python worker, from a factory that is sent to the workers. Model
libraries are imported by their factories only, so that none is needed for the others.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from typing import NamedTuple, Protocol


class Parse(NamedTuple):
    """tokens: dicts (i, text, lemma, pos, tag, dep, head, ent_type, ent_iob, char_start, char_end); entities: dicts (text, label, char_start, char_end, token_start, token_end, head_token, grammatical_role)."""

    tokens: list[dict]
    entities: list[dict]


class Annotator(Protocol):
    def parse(self, text: str) -> Parse: ...

    def clusters(self, text: str) -> list[list[tuple[int, int]]]:
        """Coreference clusters as half-open character spans.

        An annotator may also have `clusters_many(texts)`, which gives those of several texts in their order,
        and `batch_size`, the number of texts that it is given at most (16).
        """
        ...


_factories: dict[str, Callable[..., Annotator]] = {}


def register(name: str):
    def keep(factory):
        _factories[name] = factory
        return factory

    return keep


def build(name: str, **options) -> Annotator:
    if name not in _factories:
        raise ValueError(f"unknown annotator {name!r}; there are {', '.join(sorted(_factories))}")
    return _factories[name](**options)


_models: dict[str, object] = {}


def built(factory: bytes):
    """What a pickled factory builds: once in a worker process, however many tasks ask for it."""
    key = hashlib.sha256(factory).hexdigest()
    if key not in _models:
        _models[key] = pickle.loads(factory)()
    return _models[key]


def valid_spans(text: str, offsets: list[tuple[int, int]], clusters: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Character spans of clusters given as token ranges with inclusive ends; ranges outside the tokens are left out."""
    n = len(offsets)
    return [[(offsets[a][0], offsets[b][1]) for a, b in c if 0 <= a <= b < n] for c in clusters]
