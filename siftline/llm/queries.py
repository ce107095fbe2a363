"""The registered query of each operator, and DuckDB SQL for those that SQL can express."""

from .decontamination import OP5_SQL, op5_decontamination
from .html_extraction import op7_html_extraction
from .mixing import op3_mixing
from .quality_rules import op6_quality_rules
from .simhash import op9_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op1_token_counts
from .token_output import op8_token_output
from .url_filters import op10_url_filters
from .warc import OP2_SQL, op2_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_mixing, op4_substring_dedup, op5_decontamination, op6_quality_rules, op7_html_extraction, op8_token_output, op9_simhash, op10_url_filters)}

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op5_decontamination": OP5_SQL}
