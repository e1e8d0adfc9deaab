"""Errors by what failed, under one base class."""


class FeatureError(Exception):
    """Base of the package's errors."""


class DecodeError(FeatureError, ValueError):
    """Bytes or text that are no feature, geometry or header."""


class EncodeError(FeatureError, ValueError):
    """A value that a format can't hold."""


class StorageError(FeatureError, OSError):
    """A dataset or file that can't be opened."""


class FeatureCountMismatch(FeatureError, ValueError):
    """The number of leaves isn't the number that was announced."""
