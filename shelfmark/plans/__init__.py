"""The registered queries: each operator on the given tables, beside the SQL that checks it."""

from . import catalog, marks, names, search, selection  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
