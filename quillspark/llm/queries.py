"""The registered queries of this subpackage and their SQL."""

from quillspark.llm import oracles
from quillspark.llm.decontamination import op9_benchmark_decontamination
from quillspark.llm.fill_in_middle import op13_fill_in_middle
from quillspark.llm.language_id import op5_language_id
from quillspark.llm.mixing import op6_mixing
from quillspark.llm.ngram_join import op4_ngram_jaccard_join
from quillspark.llm.quality_gam import op2_quality_classifier
from quillspark.llm.quality_rules import op10_quality_rules
from quillspark.llm.secret_scan import op11_secret_scan
from quillspark.llm.sharding import op3_sharding
from quillspark.llm.source_divergence import op12_source_divergence
from quillspark.llm.substring_dedup import op7_substring_dedup
from quillspark.llm.toxicity import op1_toxicity
from quillspark.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
