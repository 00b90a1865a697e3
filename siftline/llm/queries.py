"""The registered queries of the corpus operators."""

from siftline.llm.decontaminate import op2_decontaminate
from siftline.llm.extract import op6_html_extraction
from siftline.llm.jaccard import op8_jaccard_join
from siftline.llm.licenses import op4_license_scan
from siftline.llm.mixing import op7_lm_scoring
from siftline.llm.oracle import ORACLE_SQL
from siftline.llm.packing import op9_best_fit_packing
from siftline.llm.quality import op1_quality_rules
from siftline.llm.sketches import op13_document_fingerprints
from siftline.llm.spelling import op11_spelling_variants
from siftline.llm.suffixes import op5_suffix_dedup
from siftline.llm.tries import op12_prefix_trie
from siftline.llm.urls import op10_url_filter
from siftline.llm.warc import op3_warc_bundles

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_document_fingerprints": op13_document_fingerprints,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
