"""Imports every module that registers queries."""

from .functions import keys, text_bytes  # noqa: F401
from .operators import aggregates, filters, joins, maintenance, rules, sequences, setops, topk  # noqa: F401
from . import plugins  # noqa: F401
from .plans import objects, queries  # noqa: F401
from .sources import listing, stores  # noqa: F401
from .streaming import events  # noqa: F401
