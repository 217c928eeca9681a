"""Parameters of the engine, in one frozen record; environment values can override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # The defaults that results depend on.
    entity_growth: float = 1.0
    min_entities: int = 1
    min_buffer_chars: int = 28
    min_content_words: int = 5
    cooldown_s: float = 0.3
    reuse: float = 0.75
    silence_s: float = 1.2
    orthogonality: float = 0.85
    max_sub_queries: int = 4
    sparse_top: int = 10
    dense_top: int = 10
    rrf_k: int = 60
    fused_top: int = 8
    final_top: int = 5
    chunk_words: int = 90
    min_chunk_words: int = 15
    k1: float = 1.5
    b: float = 0.75
    dim: int = 512
    digest: str = "blake2b"
    usd_1k_in: float = 0.003
    usd_1k_out: float = 0.015
    usd_retrieval: float = 0.00002
    session_ttl_s: int = 1800
    min_support: float = 0.18
    min_claim_score: float = 0.20
    min_relevance: float = 0.30
    min_query_overlap: float = 0.35
    entail_lexical: float = 0.6
    entail_semantic: float = 0.72
    # Switches.
    use_sparse: bool = True
    use_dense: bool = True
    use_reranker: bool = True
    always_wait: bool = False
    draft_general: bool = False
    contextualise: bool = False

    @classmethod
    def from_env(cls, prefix: str = "LORESPAN_", env: dict[str, str] | None = None) -> Settings:
        """Values of prefix + NAME, where they can be read as the field's type; the default otherwise."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                try:
                    found[f.name] = _cast(raw, type(f.default))
                except ValueError:
                    pass
        return cls(**found)

    @property
    def calls(self) -> int:
        """Retrieval calls of one search."""
        return int(self.use_sparse) + int(self.use_dense) or 1


def _cast(raw: str, kind: type):
    if kind is bool:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    return kind(raw)


DEFAULT = Settings()
