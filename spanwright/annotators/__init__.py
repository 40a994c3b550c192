"""Annotators: what parses segments, finds entities and coreference clusters."""

from .base import Annotator, Parse, build, register
from .rules import RuleAnnotator

__all__ = ["Annotator", "Parse", "RuleAnnotator", "build", "register"]
