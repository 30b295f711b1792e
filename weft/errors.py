"""Errors of the engine; each says what it names."""


class WeftError(Exception):
    pass


class GraphError(WeftError):
    """A cycle, or an edge to a node that isn't there."""


class ProfileError(WeftError):
    pass


class TaskError(WeftError):
    """A task failed. log: what the run did before."""

    def __init__(self, message: str, log: list[str] | None = None):
        super().__init__(message)
        self.log = log or []


class HashError(WeftError):
    pass


class StateStoreError(WeftError):
    pass
