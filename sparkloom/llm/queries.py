"""Registered queries of the corpus operators, and SQL where SQL can say it."""

from __future__ import annotations

from .centroids import op13_centroid_clustering
from .centroids import oracle as centroid_sql
from .decontamination import op8_decontamination
from .language_id import op2_language_id
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op7_license_scan
from .line_quality import op3_line_quality
from .near_dedup import op5_near_dedup
from .periodic_runs import op12_periodic_runs
from .pseudonyms import op9_pseudonyms
from .quality_classifier import op1_quality_classifier
from .repeat_removal import op6_repeat_removal
from .sequence_packing import op4_sequence_packing
from .token_output import op10_token_output
from .warc import ORACLE as WARC_SQL
from .warc import op11_warc_bundles

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_line_quality": op3_line_quality,
    "op4_sequence_packing": op4_sequence_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_repeat_removal": op6_repeat_removal,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_token_output": op10_token_output,
    "op11_warc_bundles": op11_warc_bundles,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op7_license_scan": LICENSE_SQL,
    "op11_warc_bundles": WARC_SQL,
    "op13_centroid_clustering": centroid_sql(),
}
