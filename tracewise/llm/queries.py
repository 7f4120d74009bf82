"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP10_SQL, op10_decontaminate
from .licenses import op8_license
from .packing import op6_pack
from .pii import op3_pii
from .quality import op5_quality
from .simhash import op1_simhash
from .token_counts import op7_token_counts
from .toxicity import op4_toxicity
from .urlfilter import OP9_SQL, op9_url_filter
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_pack": op6_pack,
    "op7_token_counts": op7_token_counts,
    "op8_license": op8_license,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES = {"op2_warc": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_decontaminate": OP10_SQL}
