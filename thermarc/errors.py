"""Errors of methodology and configuration. Findings about data are rows, not exceptions."""


class ThermarcError(Exception):
    """Base class; keyword details are kept in `context`."""

    def __init__(self, message: str, **context):
        super().__init__(message if not context else f"{message} ({', '.join(f'{k}={v!r}' for k, v in sorted(context.items()))})")
        self.context = context


class ConfigError(ThermarcError):
    """A setting is unknown, missing or out of range."""


class SchemaError(ThermarcError):
    """A table or mapping doesn't fit the canonical schema."""


class IngestError(ThermarcError):
    """A source can't be read as declared."""


class ProvenanceError(ThermarcError):
    """Rows without a known source, or a source that isn't what it was."""


class ConflictError(IngestError):
    """Rows with one key have different contents."""


class SplitError(ThermarcError):
    """A split isn't chronological or leaves a part empty."""


class GuardError(ThermarcError):
    """A step would use what it must not see."""


class FitError(ThermarcError):
    """Statistics or a model can't be fitted, or are used before that."""


class RuleError(ThermarcError):
    """A rule set is malformed."""


class StoreError(ThermarcError):
    """An experiment can't be stored, found or reproduced."""
