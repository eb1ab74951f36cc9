"""Schemas of the linkage tables and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

BIBITEMS = "paper_id string, ord int, key string, note string, author string, year string, arxiv string, authors_norm array<string>, note_norm string, title_tokens array<string>, author_tokens array<string>, tokens_source string"
REFERENCES = "paper_id string, ord int, id string, title string, authors array<string>, authors_norm array<string>, title_tokens array<string>, author_tokens array<string>, year string, arxiv string, note_norm string"
FEATURES = (
    "levenshtein", "jaccard", "token_overlap", "token_overlap_ratio", "char_ngram_3", "char_ngram_4", "char_ngram_5", "author_overlap",
    "author_lastname_match", "year_match", "year_diff", "source_year", "cand_year",
)
MATCHES = "paper_id string, bib_key string, cand_id string, score double, levenshtein double, jaccard double, token_overlap int, token_overlap_ratio double, char_ngram_3 double, char_ngram_4 double, char_ngram_5 double, author_overlap double, author_lastname_match double, year_match int, year_diff int, source_year int, cand_year int, label int"
#: Features of the published model.
MODEL_FEATURES = ("levenshtein", "year_match", "year_diff", "source_year", "cand_year", "author_overlap", "author_lastname_match")
RAW_REFERENCES = "map<string, struct<paper_title: string, authors: array<string>, submission_date: string>>"


@dataclass(frozen=True)
class Settings:
    """scope: 'paper' fits term weights in each paper after caps, 'split' once over all papers before caps."""

    threshold: float = 0.7
    neg_per_bib: int | None = 10
    negatives: str = "hard"
    scope: str = "paper"
    max_refs: int | None = None
    max_bibs: int | None = None
    seed: int = 23120334
    test_share: float = 0.125
    val_share: float = 0.125
    duplicate_manual: bool = False
