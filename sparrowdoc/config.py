"""Constants that shape queries, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, fusion and chunking; ``checked`` tells what is wrong with a change."""

    semantic_weight: float = 0.6
    keyword_weight: float = 0.4
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    fusion: str = "rrf"
    chunk_size: int = 512
    chunk_overlap: int = 50
    least_chunk: int = 100
    ocr_threshold: float = 0.6
    embedding_dims: int = 384

    def checked(self) -> list[str]:
        out = []
        if not 0 <= self.semantic_weight <= 1 or not 0 <= self.keyword_weight <= 1:
            out.append("weights lie in 0..1")
        if self.chunk_overlap >= self.chunk_size:
            out.append("the overlap is smaller than a chunk")
        if self.rrf_k < 1 or self.embedding_dims < 1:
            out.append("rrf_k and embedding_dims are positive")
        return out

    def changed(self, values: dict[str, str]) -> Config:
        """A copy with values given as text, such as from the environment; unknown names are left out."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: kinds[k](v) for k, v in values.items() if k in kinds})
