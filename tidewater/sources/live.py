"""Pages of contracts as a Spark source: a partition for each contract and range of cursors, followed by start_after.

    spark.dataSource.register(ContractPages)
    pages = spark.read.format("contract_pages").options(client="my_client:ask", contracts="a,b", query="get_basket_positions", limit="30", cursor="user").load()

client names a function (contract, query, params) -> JSON text; params are user, start_after and limit. Executors call
it, so it must be importable there. Filters on contract and user are pushed down: the first drops partitions, the
second is asked of the contract (with spark.sql.python.filterPushdown.enabled). The rows have the form of landed pages.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


class Range(InputPartition):
    """Cursors after `after` (null: from the first one) up to `until` (null: to the last one) of a contract."""

    def __init__(self, contract: str, after: str | None, until: str | None):
        super().__init__(None)
        self.contract, self.after, self.until = contract, after, until


def _get(item, path: str):
    for part in path.split("."):
        item = item[int(part)] if isinstance(item, list) else item[part]
    return item


class ContractPages(DataSource):
    """Options: client, contracts, query, limit; cursor (path to an item's cursor; without it there is one page), items
    (path to the list; without it the answer is the list), numeric (whether cursors are numbers), bounds (JSON list of
    cursors that part the ranges), user."""

    @classmethod
    def name(cls) -> str:
        return "contract_pages"

    def schema(self) -> str:
        return "contract string, query string, user string, start_after string, until string, limit long, landed_at long, body string, error string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.user = options.get("user")
        self.contracts = [c.strip() for c in options["contracts"].split(",") if c.strip()]
        self.limit = int(options.get("limit", "30"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contract",):
                self.contracts = [c for c in self.contracts if c == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("user",) and self.user in (None, f.value):
                self.user = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        bounds = [None, *json.loads(self.options.get("bounds", "[]")), None]
        return [Range(c, a, b) for c in self.contracts for a, b in zip(bounds, bounds[1:])]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, function = self.options["client"].split(":")
        ask = getattr(importlib.import_module(module), function)
        query, path = self.options["query"], self.options.get("cursor")
        order = int if self.options.get("numeric", "false") == "true" else str
        after = partition.after
        while True:
            asked = {"user": self.user, "start_after": after, "limit": self.limit}
            page = lambda until, body, error: (partition.contract, query, self.user, after, until, self.limit, int(time.time()), body, error)  # noqa: E731, B023
            try:
                body = ask(partition.contract, query, asked)
            except Exception as e:  # an answer that fails is a page with an error, and ends its range only
                yield page(None, None, f"{type(e).__name__}: {e}")
                return
            try:
                answer = json.loads(body)
                items = _get(answer, self.options["items"]) if "items" in self.options else answer
                cursors = [_get(x, path) for x in items] if path else []
            except (ValueError, KeyError, IndexError, TypeError):
                yield page(None, body, None)  # what can't be read is quarantined by its reader; no cursor goes on from it
                return
            over = partition.until is not None and (len(items) < self.limit or order(cursors[-1]) >= order(partition.until))
            if over and any(order(c) > order(partition.until) for c in cursors):
                items[:] = [x for x, c in zip(items, cursors) if order(c) <= order(partition.until)]
                body = json.dumps(answer)
            yield page(partition.until if over else None, body, None)
            if over or len(cursors) < self.limit or str(cursors[-1]) == after:
                return
            after = str(cursors[-1])
