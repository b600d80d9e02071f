"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

from .decontamination import OP7_SQL, op7_decontamination
from .media import PAYLOADS_SQL, media_payloads, op2_media
from .mixing import TARGETS_SQL, mixing_targets, op3_mixing
from .paragraphs import op5_paragraphs
from .pii import op6_pii
from .simhash import op1_simhash
from .suffixes import OP9_SQL, op9_suffix_array
from .toxicity import op8_toxicity
from .urlfilter import OP4_SQL, op4_url_filter
from .warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_simhash, op2_media, op3_mixing, op4_url_filter, op5_paragraphs, op6_pii, op7_decontamination, op8_toxicity, op9_suffix_array, op10_warc, media_payloads, mixing_targets)}
ORACLES = {"op4_url_filter": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_suffix_array": OP9_SQL, "op10_warc": OP10_SQL, "media_payloads": PAYLOADS_SQL, "mixing_targets": TARGETS_SQL}

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
