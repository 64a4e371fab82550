"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .op01_toxicity import op1_toxicity
from .op02_quality_rules import ORACLE as _sql2
from .op02_quality_rules import op2_quality_rules
from .op03_sentencepiece import op3_sentencepiece
from .op04_secret_scans import op4_secret_scans
from .op05_minhash import ORACLE as _sql5
from .op05_minhash import op5_minhash
from .op06_url_filters import ORACLE as _sql6
from .op06_url_filters import op6_url_filters
from .op07_language_id import op7_language_id
from .op08_embedding_dedup import ORACLE as _sql8
from .op08_embedding_dedup import op8_embedding_dedup
from .op09_substring_dedup import ORACLE as _sql9
from .op09_substring_dedup import op9_substring_dedup
from .op10_source_mixing import op10_source_mixing
from .op11_quality_classifier import op11_quality_classifier
from .op12_vector_codes import ORACLE as _sql12
from .op12_vector_codes import op12_vector_codes
from .op13_periodic_runs import op13_periodic_runs

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_secret_scans": op4_secret_scans,
    "op5_minhash": op5_minhash,
    "op6_url_filters": op6_url_filters,
    "op7_language_id": op7_language_id,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op2_quality_rules": _sql2,
    "op5_minhash": _sql5,
    "op6_url_filters": _sql6,
    "op8_embedding_dedup": _sql8,
    "op9_substring_dedup": _sql9,
    "op12_vector_codes": _sql12,
}
