"""Mora-wise analysis of Japanese kana text as ordinary Spark column expressions."""

from hakuspark.functions.core import count_all
from hakuspark.functions.phonetic import choon_to_vowel, vowel_to_choon
from hakuspark.functions.tables import CONVERSION_TABLE
from hakuspark.operators.moracol import MoraCol

__all__ = ["CONVERSION_TABLE", "MoraCol", "choon_to_vowel", "count_all", "vowel_to_choon"]
