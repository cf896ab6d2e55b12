"""Pluggable models: protocols, and deterministic built-ins so that every job runs offline."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Judge(Protocol):
    def score(self, sample: dict) -> dict[str, float]: ...


class QueryRewriter(Protocol):
    def rewrite(self, query: str) -> tuple[str, list[str]]: ...


class HashingEmbedder:
    """Signed sums of hashed words, normalised; equal texts get equal vectors on every machine.

    A text whose words cancel out is taken as one word, so that only a blank text has no direction.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            words = text.lower().split()
            for own in (words, [" ".join(words)] if words else []):
                if not row.any():
                    for word in own:
                        h = xxhash.xxh64_intdigest(word.encode())
                        row[(h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class CoverageReranker:
    """Share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(len(words), 1) for t in texts]


class OverlapJudge:
    """Proxy metrics from word overlap of question, answer, contexts and reference."""

    def score(self, sample: dict) -> dict[str, float]:
        words = lambda x: set((x or "").lower().split())
        share = lambda a, b: len(a & b) / len(a) if a else 0.0
        context = words(" ".join(sample.get("contexts") or []))
        answer, question = words(sample.get("response")), words(sample.get("question"))
        out = {"faithfulness": share(answer, context), "answer_relevancy": share(question, answer), "context_precision": share(question, context)}
        if sample.get("reference"):
            out["context_recall"] = share(words(sample["reference"]), context)
        return out


class IdentityRewriter:
    def rewrite(self, query: str) -> tuple[str, list[str]]:
        return query, []
