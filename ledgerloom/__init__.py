"""Document analytics on Spark."""

from __future__ import annotations


def ship(spark) -> None:
    """Send this package to the executors of a session, where it isn't installed there (for instance from a notebook)."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", here.parent, here.name))
