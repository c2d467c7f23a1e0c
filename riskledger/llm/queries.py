"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from riskledger.llm.conversation_repair import op12_conversation_repair
from riskledger.llm.decontaminate import op1_decontamination
from riskledger.llm.langid import op10_language_id
from riskledger.llm.line_dedup import op6_line_dedup
from riskledger.llm.minhash_dedup import OP11_SQL, op11_minhash_dedup
from riskledger.llm.mixing import op3_mixing
from riskledger.llm.ngram_join import OP9_SQL, op9_ngram_jaccard_join
from riskledger.llm.pii import op2_pii
from riskledger.llm.pitman_yor import op5_pitman_yor
from riskledger.llm.source_audit import OP13_SQL, op13_source_audit
from riskledger.llm.token_output import op8_token_output
from riskledger.llm.warc import OP7_SQL, op7_warc
from riskledger.llm.winnow import op4_fingerprints

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_token_output": op8_token_output,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_audit": op13_source_audit,
}

ORACLES: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
    "op11_minhash_dedup": OP11_SQL,
    "op13_source_audit": OP13_SQL,
}
