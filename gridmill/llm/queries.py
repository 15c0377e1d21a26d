"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gridmill.llm.bpe import op7_bpe_encoding
from gridmill.llm.decontaminate import op8_benchmark_decontamination
from gridmill.llm.embedding_dedup import op1_embedding_near_dedup
from gridmill.llm.language_model import op5_lm_scoring
from gridmill.llm.licenses import SQL as LICENSE_SQL
from gridmill.llm.licenses import op9_license_scan
from gridmill.llm.merkle import SQL as MERKLE_SQL
from gridmill.llm.merkle import op12_merkle_manifest
from gridmill.llm.nearest import op13_approximate_nearest_neighbours
from gridmill.llm.quality import op10_quality_classifier
from gridmill.llm.secrets import op6_secret_scan
from gridmill.llm.simhash import op3_simhash_near_dedup
from gridmill.llm.spelling import SQL as SPELLING_SQL
from gridmill.llm.spelling import op11_spelling_variant_grouping
from gridmill.llm.suffix_dedup import op2_suffix_array_dedup
from gridmill.llm.window_dedup import op4_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_suffix_array_dedup,
        op3_simhash_near_dedup,
        op4_substring_dedup,
        op5_lm_scoring,
        op6_secret_scan,
        op7_bpe_encoding,
        op8_benchmark_decontamination,
        op9_license_scan,
        op10_quality_classifier,
        op11_spelling_variant_grouping,
        op12_merkle_manifest,
        op13_approximate_nearest_neighbours,
    )
}

ORACLE_SQL = {"op9_license_scan": LICENSE_SQL, "op11_spelling_variant_grouping": SPELLING_SQL, "op12_merkle_manifest": MERKLE_SQL}
