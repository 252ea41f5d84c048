"""Python data sources: market history by symbol (batch) and polled quotes (streaming).

Network clients are given by the user: the option ``client`` names an importable function,
so the engine itself has no connector code and tests run offline. Symbols are partitions.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "symbol string, ts timestamp, price double, volume double"


def client(name: str):
    """The function ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class SymbolPartition(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.client, self.days = options["client"], int(options.get("days", "90"))

    def partitions(self) -> list[InputPartition]:
        return [SymbolPartition(s) for s in self.symbols]

    def read(self, partition: SymbolPartition) -> Iterator[tuple]:
        for ts, price, volume in client(self.client)(partition.symbol, self.days):
            yield partition.symbol, ts, float(price), float(volume)


class PollingReader(SimpleDataSourceStreamReader):
    """Each micro-batch asks the client for rows after the offset."""

    def __init__(self, options: dict):
        self.client, self.symbols = options["client"], [s for s in options.get("symbols", "").split(",") if s]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict):
        rows, at = [], start["at"]
        for s in self.symbols:
            for position, ts, price, volume in client(self.client)(s, start["at"]):
                rows.append((s, ts, float(price), float(volume)))
                at = max(at, position + 1)
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        rows, _ = self.read(start)
        return rows


class MarketHistory(DataSource):
    """``spark.dataSource.register(MarketHistory)``, then format("market_history")."""

    @classmethod
    def name(cls) -> str:
        return "market_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return PollingReader(self.options)
