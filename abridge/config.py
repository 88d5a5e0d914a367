"""Parameters of a summary. The defaults here are plain tf-idf; `api.SUMMARY` has those of a whole summary. `idf_mode` and `zero_idf_as_one` reproduce known slips."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    length: int = 300
    unit: str = "WORDS"  # or SENTENCES, CHARACTERS
    coverage: float = 5.0
    diversity: float = 6.0
    cost_exponent: float = 0.3
    min_tokens: int = 4
    stemmer: str = "none"  # or porter, porter2
    bigrams: bool = True
    idf_mode: str = "real"  # or floor
    idf_unit: str = "documents"  # or sentences, in sets of several documents
    zero_idf_as_one: bool = False
    use_tfidf: bool = True
    use_sentiment: bool = False
    use_embeddings: bool = False
    aggregate: str = "mult"  # avg, l2, l3, l4, l100, max, min
    cluster_on_aggregate: bool = False
    strict_length: bool = False
    cost_weight: bool = False
    singleton: bool = True
    prune: float = 0.0
    pronouns: tuple[str, ...] = ()
    mean_diversity: bool = False  # a sentence alone counts its mean similarity, without a root
    clusterings: str = "one"  # or each: one of every measure
    clustering: str = "medoids"  # or pam, distances
    counting: str = "tokens"  # or pieces
    seed: int = 7
    input_limit: int | None = None
    clusters_in_place: bool = False
    resolve_pronouns: bool = False
    kernel_limit: int = 4000  # sentences of a set that one task takes; larger sets go by joins

    def __post_init__(self):
        if self.unit not in ("WORDS", "SENTENCES", "CHARACTERS"):
            raise ValueError(f"unknown length unit {self.unit}")
        for name, known in (("stemmer", ("none", "porter", "porter2")), ("idf_mode", ("real", "floor")), ("idf_unit", ("documents", "sentences")), ("clusterings", ("one", "each")), ("clustering", ("medoids", "pam", "distances")), ("counting", ("tokens", "pieces"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.aggregate not in ("mult", "avg", "l2", "l3", "l4", "l100", "max", "min"):
            raise ValueError(f"unknown aggregate {self.aggregate}")

    @property
    def measures(self) -> tuple[str, ...]:
        """Names of measures in use, in the order in which they are multiplied; tf-idf if none is left."""
        found = ("pos", "neg") * self.use_sentiment + ("embed",) * self.use_embeddings + ("tfidf",) * self.use_tfidf
        return found or ("tfidf",)
