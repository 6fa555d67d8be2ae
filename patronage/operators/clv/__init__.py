"""Probabilistic CLV: BG/NBD purchase counts and Gamma-Gamma spend."""
from .summary import clv_summary  # noqa: F401
from .models import BGNBDParams, GammaGammaParams  # noqa: F401
