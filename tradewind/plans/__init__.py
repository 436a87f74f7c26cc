"""Parameter sets and end-to-end report plans."""

from .params import FIXTURE, Params
from .present import present
from .reports import REPORTS

__all__ = ["FIXTURE", "Params", "REPORTS", "present"]
