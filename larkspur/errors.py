"""What can go wrong."""


class LarkspurError(Exception):
    """Any of the engine's errors."""


class InvalidArgument(LarkspurError, ValueError):
    pass


class DimensionMismatch(InvalidArgument):
    pass


class NotFound(LarkspurError, KeyError):
    pass


class StorageError(LarkspurError):
    pass


class TokenizerError(LarkspurError):
    pass


class PayloadError(LarkspurError):
    pass
