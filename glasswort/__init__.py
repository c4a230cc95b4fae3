"""Provenance of files, evaluation of detectors, and (in glasswort.llm) training-data operators."""

from .operators.calibrate import FusionModel, Probe
from .operators.provenance import provenance
from .operators.scoring import DETECTORS, predictions, register
from .session import session

__all__ = ["DETECTORS", "FusionModel", "Probe", "predictions", "provenance", "register", "session"]
