"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from duosignal.llm.binary_ids import op13_binary_ids
from duosignal.llm.html_text import op3_html_extraction
from duosignal.llm.importance import op12_importance_resampling
from duosignal.llm.language import op4_language_id
from duosignal.llm.licenses import op7_license_scans
from duosignal.llm.mixing import op6_mixing_weights
from duosignal.llm.ngram_jaccard import op1_ngram_jaccard
from duosignal.llm.packing import op10_best_fit_packing
from duosignal.llm.quality import op8_quality_rules
from duosignal.llm.spelling import op11_spelling_variants
from duosignal.llm.sql import IMPORTANCE_RESAMPLING, LICENSE_SCANS, NGRAM_JACCARD, SPELLING_VARIANTS
from duosignal.llm.suffix_dedup import op2_suffix_dedup
from duosignal.llm.tiff import op5_media_tiff
from duosignal.llm.tokens import op9_token_counts


def queries() -> dict[str, Callable]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_language_id": op4_language_id,
        "op5_media_tiff": op5_media_tiff,
        "op6_mixing_weights": op6_mixing_weights,
        "op7_license_scans": op7_license_scans,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_binary_ids": op13_binary_ids,
    }


def oracle_sql() -> dict[str, str]:
    """The others hold models, media, tokens or packing, and are tested against brute force."""
    return {"op1_ngram_jaccard": NGRAM_JACCARD, "op7_license_scans": LICENSE_SCANS, "op11_spelling_variants": SPELLING_VARIANTS, "op12_importance_resampling": IMPORTANCE_RESAMPLING}
