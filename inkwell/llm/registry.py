"""Queries of this subpackage and their SQL, by name. __spark_entry__.py adds them when the subpackage is there."""

from __future__ import annotations

from .decontaminate import op8_decontaminate
from .importance_resampling import op13_importance_resampling
from .language_id import op7_language_id
from .line_dedup import op10_line_dedup
from .lm_scoring import op4_lm_scoring
from .oracles import OP2_SQL, OP8_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from .periodic_runs import op11_periodic_runs
from .quality_rules import ABLATION_SQL, OP5_SQL, op5_quality_rules, quality_ablations
from .secret_scan import op12_secret_scan
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op6_simhash
from .suffix_dedup import op2_suffix_dedup
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_importance_resampling": op13_importance_resampling,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
    "quality_ablations": ABLATION_SQL,
}
