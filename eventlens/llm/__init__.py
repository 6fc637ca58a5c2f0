"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
gather what the operator modules register.
"""

from __future__ import annotations

from eventlens.llm import (
    ann,
    bpe,
    clustering,
    decontaminate,
    fingerprints,
    importance,
    license_scan,
    ngram_jaccard,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    url_filter,
)

_MODULES = (
    url_filter,
    token_counts,
    license_scan,
    bpe,
    secret_scan,
    decontaminate,
    ngram_jaccard,
    ann,
    substring_dedup,
    quality,
    clustering,
    importance,
    fingerprints,
)


def queries() -> dict:
    """Query name -> callable (spark, sf_dir) of every operator here."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, for those that SQL can express."""
    return {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
