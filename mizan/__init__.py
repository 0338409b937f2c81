"""Arabic morphology and corpus analytics on Spark."""

from __future__ import annotations

from importlib import import_module

from mizan.schemas import AFFIX_SCHEMA, ANALYSIS_SCHEMA, INFLECTION_SCHEMA, TOKEN_SCHEMA

__version__ = "0.1.0"

#: Names that are imported when they are first used.
_LATER = {
    "Lexicon": "mizan.sources.lexicon", "LanguageModel": "mizan.sources.language_model", "analyze_words": "mizan.plans.analyze",
    "analyze_text": "mizan.plans.disambiguate", "lemmatize": "mizan.plans.disambiguate", "tokens": "mizan.plans.disambiguate", "tokenize": "mizan.functions.text",
}
__all__ = ["AFFIX_SCHEMA", "ANALYSIS_SCHEMA", "INFLECTION_SCHEMA", "TOKEN_SCHEMA", "__version__", *_LATER]


def __getattr__(name: str):
    if name in _LATER:
        return getattr(import_module(_LATER[name]), name)
    raise AttributeError(f"module 'mizan' has no attribute {name!r}")
