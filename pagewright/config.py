"""Settings with their checks."""

from __future__ import annotations

from dataclasses import dataclass


#: The searches that each mode of retrieval runs, and the settings that only one of them reads.
SEARCHES = {"hybrid": {"vector", "bm25"}, "vector": {"vector"}, "bm25": {"bm25"}}
READ_BY = {"distance": "vector", "instruction": "vector"}


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid"
    top_k: int = 8
    retrieval_top_k: int = 0
    rrf_k: int = 60
    vector_candidates: int = 40
    bm25_candidates: int = 40
    chunk_target: int = 700
    chunk_max: int = 900
    chunk_overlap: int = 100
    embedding_batch: int = 4
    context_pages: int = 4
    max_pages: int = 200
    max_calls: int = 200

    def __post_init__(self) -> None:
        if self.mode not in SEARCHES or self.context_pages != 4 or min(self.top_k, self.rrf_k, self.chunk_target, self.chunk_max) < 1:
            raise ValueError("bad settings")

    @property
    def effective_top_k(self) -> int:
        return self.retrieval_top_k or self.top_k


@dataclass(frozen=True)
class EvaluationConfig:
    name: str
    mode: str = "hybrid"
    top_k: int = 5
    distance: str | None = "cosine"
    instruction: str | None = None
    augment: bool = False
    tag: str = ""

    def __post_init__(self) -> None:
        checks = {"name": bool(self.name.strip()), "mode": self.mode in SEARCHES, "top_k": self.top_k in range(1, 21), "distance": self.distance in (None, "l2", "cosine")}
        if wrong := [field for field, fits in checks.items() if not fits]:
            raise ValueError(f"bad evaluation settings: {wrong}")
        for field, search in READ_BY.items():  # what no search of the mode reads is not set, so equal runs have equal settings
            if search not in SEARCHES[self.mode]:
                object.__setattr__(self, field, None)
