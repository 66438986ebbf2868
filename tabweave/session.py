"""A table under work: as loaded, as processed, and what was done. Every action returns a new session."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tabweave.operators import clean, pairs
from tabweave.sources.readers import read_table


@dataclass(frozen=True)
class Session:
    initial: DataFrame
    processed: DataFrame
    log: tuple[str, ...] = ()
    source: tuple[str, int] | None = None
    results: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, cleaned: bool = False) -> Session:
        rows = clean.with_row_id(df)
        return cls(rows, clean.clean_import(rows) if cleaned else rows, ("loaded",))

    @classmethod
    def load(cls, spark: SparkSession, path: str, before: Session | None = None, size: int | None = None) -> Session:
        """Reads and cleans a file; the same file (by name and size) as before is not read again. The size is looked up unless given."""
        size = spark.read.format("binaryFile").load(path).agg({"length": "sum"}).first()[0] if size is None else size
        if before is not None and before.source == (path, size):
            return before
        return replace(cls.of(read_table(spark, path), cleaned=True), source=(path, size))

    @classmethod
    def merged(cls, frames: Sequence[DataFrame], **options: bool) -> Session:
        rows = clean.with_row_id(clean.merge(frames, **options))
        return cls(rows, rows, (f"merged {len(frames)} tables",))

    def _next(self, df: DataFrame, said: str, lost: Sequence[str] = ()) -> Session:
        kept = {k: v for k, v in self.results.items() if not set(k) & set(lost)}
        return replace(self, processed=df, log=(*self.log, said), results=kept)

    @property
    def columns(self) -> list[str]:
        return pairs.columns_of(self.processed)

    def has_data(self) -> bool:
        return bool(self.columns) and not self.processed.isEmpty()

    def drop(self, *names: str) -> Session:
        """Results about dropped columns go too."""
        return self._next(self.processed.drop(*names), f"dropped {', '.join(names)}", names)

    def concat(self, a: str, b: str) -> Session:
        return self._next(clean.concat_columns(self.processed, a, b), f"joined {a} and {b}", (a, b))

    def deduplicate(self, include_id: bool = False) -> Session:
        return self._next(clean.drop_duplicates(self.processed, include_id), "dropped duplicate rows")

    def with_frame(self, df: DataFrame, said: str) -> Session:
        return self._next(df, said)

    def with_result(self, columns: Sequence[str], result: object) -> Session:
        return replace(self, results={**self.results, tuple(columns): result})

    def preview(self, rows: int = 10) -> DataFrame:
        return self.processed.orderBy(pairs.ROW_ID).limit(rows)

    def publish(self) -> None:
        self.initial.createOrReplaceTempView("initial")
        self.processed.createOrReplaceTempView("processed")

    def clear_log(self) -> Session:
        return replace(self, log=())

    def last_log(self, lines: int = 10) -> tuple[str, ...]:
        return self.log[-lines:]
