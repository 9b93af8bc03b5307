"""tessera: SQL, retrieval and data-preparation operators as PySpark DataFrame programs."""

from tessera.session import get_spark

__all__ = ["get_spark"]
