from mirador.functions.numeric import clean_number, safe_ratio, to_fraction, uniform
from mirador.functions.text import mentions, never_mentions
from mirador.functions.timing import between, epoch_micros, micros, minutes, to_micros, whole_units

__all__ = [
    "between", "clean_number", "epoch_micros", "mentions", "micros", "minutes",
    "never_mentions", "safe_ratio", "to_fraction", "to_micros", "uniform", "whole_units",
]
