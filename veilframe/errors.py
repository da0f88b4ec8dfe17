"""Errors that never quote a value of the data."""


class VeilError(Exception):
    """What a caller may show: names of columns and settings, never cell contents."""


class ParseError(VeilError):
    """A file cannot be read."""


class PolicyError(VeilError):
    """A policy does not fit its column or its parameters are wrong."""


class BudgetError(VeilError):
    """Noise would go beyond its budget."""


class RiskError(VeilError):
    """Too many rows would be suppressed, or none would be left."""
