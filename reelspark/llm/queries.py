"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .langid import op3_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import op5_curriculum_mix
from .ngram_join import OP1_SQL, op1_ngram_join
from .packing import op6_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .quality import op7_quality_rules
from .sharding import op10_interleaved_shards
from .token_files import op4_token_files
from .toxicity import op8_toxicity
from .warc import OP12_SQL, op12_warc_bundles


def queries() -> dict:
    fs = (op1_ngram_join, op2_embedding_dedup, op3_language_id, op4_token_files, op5_curriculum_mix, op6_best_fit_packing, op7_quality_rules, op8_toxicity, op9_line_dedup, op10_interleaved_shards, op11_hard_negatives, op12_warc_bundles, op13_periodic_runs)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc_bundles": OP12_SQL}
