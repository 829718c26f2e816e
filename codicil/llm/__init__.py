"""Operators that prepare training text. Nothing outside this subpackage imports it,
except the guarded import in ``__spark_entry__.py``."""
