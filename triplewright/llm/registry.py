"""Queries of the text operators by name, each with SQL where SQL can state the same result."""

from triplewright.llm.alignment import op12_alignment
from triplewright.llm.bpe import op6_bpe
from triplewright.llm.divergence import OP11_SQL, op11_divergence
from triplewright.llm.embeddings import OP7_SQL, op7_embeddings
from triplewright.llm.html_text import op9_html
from triplewright.llm.media import op5_media
from triplewright.llm.packing import op10_packing
from triplewright.llm.pii import op1_pii
from triplewright.llm.simhash import op8_simhash
from triplewright.llm.token_counts import op2_token_counts
from triplewright.llm.token_store import op3_token_store
from triplewright.llm.toxicity import op4_toxicity
from triplewright.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_token_store": op3_token_store,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_bpe": op6_bpe,
    "op7_embeddings": op7_embeddings,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
}
ORACLE_SQL: dict[str, str] = {
    "op7_embeddings": OP7_SQL,
    "op11_divergence": OP11_SQL,
    "op13_warc": OP13_SQL,
}
