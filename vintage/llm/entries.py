"""The queries of this subpackage, by name, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vintage.llm.byte_cnn import op7_byte_cnn
from vintage.llm.circulant_minhash import ORACLE as _op6_sql
from vintage.llm.circulant_minhash import op6_circulant_minhash
from vintage.llm.html_crf import op3_html_crf
from vintage.llm.interpolated_lm import op11_interpolated_lm
from vintage.llm.quality_rules import op9_quality_rules
from vintage.llm.quotient_phrases import ORACLE as _op13_sql
from vintage.llm.quotient_phrases import op13_quotient_phrases
from vintage.llm.repair_agenda import op12_repair_agenda
from vintage.llm.rule_ensemble import op2_rule_ensemble
from vintage.llm.secret_scan import op1_secret_scan
from vintage.llm.sentencepieces import op8_sentencepiece
from vintage.llm.spaced_seeds import op4_spaced_seeds
from vintage.llm.suffix_dedup import op5_suffix_dedup
from vintage.llm.token_shards import op10_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_html_crf": op3_html_crf,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_circulant_minhash": op6_circulant_minhash,
    "op7_byte_cnn": op7_byte_cnn,
    "op9_quality_rules": op9_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op10_token_shards": op10_token_shards,
    "op11_interpolated_lm": op11_interpolated_lm,
    "op12_repair_agenda": op12_repair_agenda,
    "op13_quotient_phrases": op13_quotient_phrases,
}

#: The other operators hash, train or segment in ways that SQL cannot express;
#: their tests compare them with brute force, the libraries or held-out labels.
ORACLES: dict[str, str] = {"op6_circulant_minhash": _op6_sql, "op13_quotient_phrases": _op13_sql}
