"""The registered queries of the operators, and DuckDB counterparts where SQL can say it."""

from __future__ import annotations

from fleetlark.llm.fingerprint import op3_fingerprint
from fleetlark.llm.html import op5_html
from fleetlark.llm.language import op8_language
from fleetlark.llm.lines import op4_line_dedup
from fleetlark.llm.mixing import op9_mixing
from fleetlark.llm.negatives import OP12_SQL, op12_negatives
from fleetlark.llm.ngram_join import op7_ngram_join
from fleetlark.llm.pieces import op2_pieces
from fleetlark.llm.pii import op1_pii
from fleetlark.llm.quality import op6_quality
from fleetlark.llm.resampling import OP11_SQL, op11_resampling
from fleetlark.llm.toxicity import op13_toxicity
from fleetlark.llm.vectors import op10_near_vectors

QUERIES = {f.__name__: f for f in (op1_pii, op2_pieces, op3_fingerprint, op4_line_dedup, op5_html, op6_quality, op7_ngram_join, op8_language, op9_mixing, op10_near_vectors, op11_resampling, op12_negatives, op13_toxicity)}
ORACLES: dict[str, str] = {"op11_resampling": OP11_SQL, "op12_negatives": OP12_SQL}
