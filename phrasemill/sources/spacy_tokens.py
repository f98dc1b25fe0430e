"""Tokens of a spaCy document, and a component for spaCy's pipelines; spaCy itself is only needed to register that."""

from __future__ import annotations

from typing import Any

from ..functions import text as T
from ..operators import document as D
from ..plans.api import TextRankResult, _Extractor
from ..plans.config import TextRankConfig, variant_of


def tokens_of(doc: Any) -> list[D.Token]:
    """Of anything with ``sents`` of tokens as spaCy has them; white space isn't a token."""
    out = []
    for i, sentence in enumerate(doc.sents):
        out += [D.Token(t.text, t.lemma_ or t.text.lower(), T.py_tag_name(t.pos_), t.idx, t.idx + len(t.text), i, bool(t.is_stop)) for t in sentence if not t.is_space]
    return out


class KeyphraseComponent:
    """Puts the result under doc.user_data["phrases"] and gives the document back."""

    def __init__(self, variant: str = "textrank", config: TextRankConfig | None = None, **settings: Any):
        self.extractor = _Extractor(config)
        self.extractor.variant = variant_of(variant)
        self.extractor.settings |= settings

    def __call__(self, doc: Any) -> Any:
        found: TextRankResult = self.extractor.extract_tokens(tokens_of(doc))
        doc.user_data["phrases"] = found.phrases
        doc.user_data["phrases_converged"] = found.converged
        return doc


def register(name: str = "keyphrases") -> None:
    """Makes nlp.add_pipe(name) known; ImportError without spaCy."""
    from spacy.language import Language

    @Language.factory(name, default_config={"variant": "textrank", "top_n": 10})
    def make(nlp: Any, name: str, variant: str, top_n: int) -> KeyphraseComponent:
        return KeyphraseComponent(variant, TextRankConfig(top_n=top_n))
