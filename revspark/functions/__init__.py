from . import constants, columns, text, sizes, dates  # noqa: F401
