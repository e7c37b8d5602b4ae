"""Named record sets: a missing one is told apart from an empty one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Source:
    status: str  # ok, missing or error
    records: DataFrame | None = None
    message: str = ""
    artefacts: list[tuple[str, str, int]] = field(default_factory=list)


@dataclass
class Catalog:
    spark: SparkSession
    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, name: str, records: DataFrame, artefacts: list[tuple[str, str, int]] | None = None) -> Catalog:
        self.sources[name] = Source("ok", records, artefacts=artefacts or [])
        return self

    def load(self, name: str, read: Callable[[], DataFrame]) -> Catalog:
        """Add what `read` gives; a file that isn't there is a missing source, anything else that fails is an error."""
        try:
            records = read()
            records.schema  # noqa: B018  analysis happens here
            return self.add(name, records)
        except FileNotFoundError as e:
            self.sources[name] = Source("missing", message=str(e)[:200])
        except Exception as e:  # noqa: BLE001  one broken source must not stop the others
            missing = "PATH_NOT_FOUND" in str(e)
            self.sources[name] = Source("missing" if missing else "error", message=str(e)[:200])
        return self

    def get(self, name: str) -> DataFrame | None:
        found = self.sources.get(name)
        return found.records if found is not None and found.status == "ok" else None

    def summary(self) -> DataFrame:
        rows = [(k, s.status, s.message, len(s.artefacts)) for k, s in sorted(self.sources.items())]
        return self.spark.createDataFrame(rows, "source string, status string, message string, artefacts int")
