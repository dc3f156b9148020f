"""Errors of broken guards."""


class LabelError(ValueError):
    """Labels that are not unique, or that are missing where they must be present."""


class MissingValueError(ValueError):
    """NaN or null where the policy admits none."""


class CatalogError(ValueError):
    """A catalogue, stimulus set or assembly that breaks its rules."""
