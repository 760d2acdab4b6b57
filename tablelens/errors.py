"""The one exception type of the library."""


class ProfileError(ValueError):
    """A request that cannot be answered; ``code`` says why."""

    def __init__(self, code: str, message: str, details: dict | None = None):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.details = details or {}
