"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import hilbert, mixing, prefixtrie, revisits
from .bpe import op10_bpe_round_trip
from .hilbert import op4_hilbert_shards
from .licenses import op9_license_notices
from .mixing import op1_pareto_mix
from .personal import op12_personal_data
from .prefixtrie import op11_prefix_trie
from .rabitq import op5_rabitq_links
from .revisits import op8_revisit_resolution
from .simhash import op3_simhash_bktree
from .spotsigs import op2_spotsigs
from .substring import op7_seed_extend
from .toxicity import op6_compression_toxicity
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_spotsigs,
        op3_simhash_bktree,
        op4_hilbert_shards,
        op5_rabitq_links,
        op6_compression_toxicity,
        op7_seed_extend,
        op8_revisit_resolution,
        op9_license_notices,
        op10_bpe_round_trip,
        op11_prefix_trie,
        op12_personal_data,
        op13_whitening,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {
    "op1_pareto_mix": mixing.SQL,
    "op4_hilbert_shards": hilbert.SQL,
    "op8_revisit_resolution": revisits.SQL,
    "op11_prefix_trie": prefixtrie.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
