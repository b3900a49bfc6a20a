"""Public names in one place."""

from corvane.operators.embed import corpus, embed_distinct
from corvane.operators.embed import embed_texts as embed
from corvane.operators.generation import utterances
from corvane.operators.knn import knn, knn_lsh, recall
from corvane.operators.match import match_records, rewrite_requests
from corvane.operators.paraphrase import paraphrase_requests, score_paraphrases
from corvane.operators.scoring import evaluate, prompts
from corvane.plans.catalog import Catalog, sample_corpus
from corvane.streaming.refresh import refresh

__all__ = [
    "Catalog",
    "corpus",
    "embed",
    "embed_distinct",
    "evaluate",
    "knn",
    "knn_lsh",
    "match_records",
    "paraphrase_requests",
    "prompts",
    "recall",
    "refresh",
    "rewrite_requests",
    "sample_corpus",
    "score_paraphrases",
    "utterances",
]
