"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from strandwise.llm.alignment import op13_alignment
from strandwise.llm.fingerprints import op10_fingerprints
from strandwise.llm.jaccard import OP9_SQL, op9_jaccard
from strandwise.llm.merkle import OP11_SQL, op11_merkle
from strandwise.llm.mixing import OP3_SQL, op3_mixing
from strandwise.llm.packing import op2_packing
from strandwise.llm.personal import op7_personal
from strandwise.llm.preferences import OP4_SQL, op4_preferences
from strandwise.llm.quality import op6_quality
from strandwise.llm.search import OP8_SQL, op8_search
from strandwise.llm.sharding import OP5_SQL, op5_sharding
from strandwise.llm.substrings import OP1_SQL, op1_substrings
from strandwise.llm.warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_preferences": op4_preferences,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_personal": op7_personal,
    "op8_search": op8_search,
    "op9_jaccard": op9_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_substrings": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op4_preferences": OP4_SQL,
    "op5_sharding": OP5_SQL,
    "op8_search": OP8_SQL,
    "op9_jaccard": OP9_SQL,
    "op11_merkle": OP11_SQL,
    "op12_warc": OP12_SQL,
}
