"""Frame-level operators, and a column wrapper that behaves like a text whose unit is the mora."""

from hakuspark.operators.frames import explode_hits, explode_morae, mora_histogram
from hakuspark.operators.moracol import MoraCol

__all__ = ["MoraCol", "explode_hits", "explode_morae", "mora_histogram"]
