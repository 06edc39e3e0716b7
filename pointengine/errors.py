"""Error tree."""


class PointEngineError(Exception):
    """Base of all errors of this package."""


class UnknownDimension(PointEngineError):
    """A name that the point format does not have."""


class UnsupportedFormat(PointEngineError):
    """A point format, or a format and file version together, that does not exist."""


class IncompatibleData(PointEngineError):
    """Tables or files whose formats do not fit."""


class FilterSyntaxError(PointEngineError):
    """A filter expression that cannot be read."""


class CodecError(PointEngineError):
    """No codec can read or write a compressed file."""
