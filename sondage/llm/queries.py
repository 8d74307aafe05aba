"""All queries of this subpackage."""

from . import op1, op10, op11, op12, op13, op2, op3, op4, op5, op6, op7, op8, op9  # noqa: F401  (importing registers the cases)
from .registry import CASES, ORACLES  # noqa: F401
