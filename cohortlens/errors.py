"""What the operators raise."""


class InputError(ValueError):
    """The input tables don't fit the model."""


class APIError(InputError):
    """A workflow was asked for what it can't do."""


class SampleError(APIError):
    """Samples can't be told apart."""


class DatasetError(InputError):
    """A source can't be read."""


class ProgramError(ValueError):
    """Programs can't be fitted or are degenerate."""


class RecurrenceError(ValueError):
    """Recurrence isn't defined for these programs."""


class StateError(ValueError):
    """A scorer or state model can't be applied."""


class ProjectionError(StateError):
    """A projector can't be applied."""


class PipelineError(ValueError):
    """A pipeline configuration is inconsistent."""


class MetricsError(ValueError):
    """A report isn't defined."""


class HierarchyError(ValueError):
    """Lineages lack samples."""


class ValidationError(ValueError):
    """Promotion evidence is malformed."""
