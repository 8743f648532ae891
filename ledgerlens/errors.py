"""Errors raised when input breaks a data contract."""


class DataContractError(ValueError):
    """Rows, columns or metadata do not satisfy the documented contract."""
