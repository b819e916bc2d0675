"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from quern.llm.bpe import op8_bpe
from quern.llm.hnsw import op9_hnsw
from quern.llm.html_text import op4_html_text
from quern.llm.media import op10_iso_media
from quern.llm.mixing import OP6_SQL, op6_poisson_mix
from quern.llm.pivot_index import OP12_SQL, op12_pivot_topk
from quern.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from quern.llm.resampling import OP13_SQL, op13_importance_resampling
from quern.llm.secrets import op1_secret_scan
from quern.llm.sharding import OP3_SQL, op3_extendible_shards
from quern.llm.simhash import op2_simhash_dedup
from quern.llm.toxicity import op5_toxicity
from quern.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_simhash_dedup, op3_extendible_shards, op4_html_text, op5_toxicity,
        op6_poisson_mix, op7_warc, op8_bpe, op9_hnsw, op10_iso_media, op11_prefix_trie, op12_pivot_topk,
        op13_importance_resampling,
    )
}
ORACLE_SQL = {"op3_extendible_shards": OP3_SQL, "op6_poisson_mix": OP6_SQL, "op7_warc": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_pivot_topk": OP12_SQL, "op13_importance_resampling": OP13_SQL}
