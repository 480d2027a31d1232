"""A data source for services that hand out features page by page.

``spark.read.format("paged_features").option("template", ...)``: the template has {start} and
{count}; each page is one partition, so pages are fetched in parallel and a lost executor costs
only its pages. ``total`` is asked beforehand (see ``functions.scalar.hit_count``); ``start``
resumes a broken run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template = options["template"]
        self.total, self.count = int(options["total"]), int(options.get("count", 100_000))
        self.start = int(options.get("start", 0))

    def partitions(self) -> list[Page]:
        return [Page(s, min(self.count, self.total - s)) for s in range(self.start, self.total, self.count)]

    def read(self, page: Page) -> Iterator[tuple]:
        with urlopen(self.template.format(start=page.start, count=page.count)) as answer:  # noqa: S310
            for feature in json.load(answer)["features"]:
                yield (json.dumps(feature.get("properties")), json.dumps(feature.get("geometry")))


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "properties string, geometry string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
