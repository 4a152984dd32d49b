"""All registered queries of the reference's own operators."""

from . import chunks, evaluation, quality, retrieval, sampling  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
