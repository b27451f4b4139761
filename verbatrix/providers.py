"""Models as providers: an embedder, a scorer and a language model, each with a deterministic offline stand-in.

The stand-ins only make flows testable. Their quality says nothing about that of a real model behind the same seam.
"""

from __future__ import annotations

import json
import re
from typing import Protocol

import numpy as np
import xxhash


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of floats a text."""


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """How well each (query, passage) pair matches; larger is better."""


class LanguageModel(Protocol):
    def complete(self, system: str, user: str) -> str:
        """The model's reply at temperature 0."""


_TOKEN = re.compile(r"[a-z0-9]+")


class HashedEmbedder:
    """Bag of hashed words, of unit length. Equal texts have equal vectors wherever they are computed."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for token in _TOKEN.findall((text or "").lower()):
                h = xxhash.xxh64_intdigest(token)
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class LetterCounts:
    """How often a text has each letter from a to z, in either case: whole numbers, which any engine can restate."""

    dimension = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            # In UTF-8 these bytes are these letters and nothing else, so one pass counts them all.
            n = np.bincount(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
            row[:] = n[97:123] + n[65:91]
        return out


class LexicalScorer:
    """The share of the query's words that the passage has, spread to the range -6 to 9."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            wanted = set(_TOKEN.findall((query or "").lower()))
            there = set(_TOKEN.findall((passage or "").lower()))
            out.append(15.0 * len(wanted & there) / len(wanted) - 6.0 if wanted else -6.0)
        return out


class ExtractiveModel:
    """Answers with the first sentence of the first passages and cites them; supports a claim whose words are in the passage."""

    def __init__(self, passages: int = 2):
        self.passages = passages

    def complete(self, system: str, user: str) -> str:
        if "Claim:" in user:
            passage, _, claim = user.partition("Claim:")
            words = set(_TOKEN.findall(claim.split("\n\n")[0].lower()))
            have = set(_TOKEN.findall(passage.lower()))
            share = len(words & have) / len(words) if words else 0.0
            return "YES - the words are there" if share >= 0.8 else "NO - words are missing"
        if "Facts:" in user:
            answer, _, facts = user.partition("Facts:")
            have = set(_TOKEN.findall(answer.lower()))
            lines = [f.split(". ", 1)[-1] for f in facts.strip().split("\n") if re.match(r"\d+\. ", f)]
            judge = lambda f: bool(w := set(_TOKEN.findall(f.lower()))) and len(w & have) / len(w) >= 0.6
            return json.dumps([judge(f) for f in lines])
        found = re.findall(r"^\[(\d+)\] \([^\n]*\)\n([^\n]*)", user, re.MULTILINE)[: self.passages]
        if not found:
            return "The context does not provide this."
        return " ".join(f"{re.split(r'(?<=[.!?]) ', t)[0].strip()} [{n}]." for n, t in found)
