"""Errors a caller can act on."""


class PlanError(ValueError):
    """The graph can't be planned: a missing input, an unknown or mistyped column, mismatched inputs."""


class EditError(ValueError):
    """A command that the document refuses."""
