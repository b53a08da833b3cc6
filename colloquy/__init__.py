"""colloquy: dialogue-corpus preparation and training/decoding analytics as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from DataFrame/SQL
expressions, windows, joins and aggregates; nothing collects rows to the driver.
"""

from colloquy.session import configure, checkpoint_dir  # noqa: F401

__all__ = ["configure", "checkpoint_dir"]
