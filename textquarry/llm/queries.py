"""The queries of this subpackage and the SQL that states their results."""

from textquarry.llm.chat import OP11_SQL, op11_chat_format
from textquarry.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from textquarry.llm.lexical import OP13_SQL, op13_lexical_search
from textquarry.llm.line_dedup import OP1_SQL, op1_line_dedup
from textquarry.llm.merkle import OP12_SQL, op12_merkle_manifest
from textquarry.llm.minhash_dedup import OP4_SQL, op4_minhash_dedup
from textquarry.llm.packing import op3_pack
from textquarry.llm.planes import op9_bit_planes
from textquarry.llm.quality_classifier import op10_quality_classifier
from textquarry.llm.quality_rules import OP5_SQL, op5_quality_rules
from textquarry.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from textquarry.llm.tokens import op2_bpe_encode
from textquarry.llm.warc import OP6_SQL, op6_warc_bundles

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe_encode": op2_bpe_encode,
    "op3_pack": op3_pack,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_bundles": op6_warc_bundles,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bit_planes": op9_bit_planes,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_chat_format": op11_chat_format,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op4_minhash_dedup": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_warc_bundles": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
