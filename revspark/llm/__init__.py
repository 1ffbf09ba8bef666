"""Operators of a training-data pipeline (dealt methods), one module per operator.

Nothing else in the library imports this subpackage; the driver contract adds its queries
only when it is present."""
