"""Pages over HTTP as a Spark data source: ``spark.read.format("pages")``.

One partition holds all links of a host, so that a single task keeps that host's pace. Options: ``urls``
(separated by white space), ``delay`` (seconds between requests to a host), ``timeout``, ``retries``,
``agent``, ``robots`` (true or false). fetched() takes links from a DataFrame instead, of any number.

Paged services: ``spark.read.format("paged")`` with ``url`` (``{kind}`` and ``{page}`` are filled in), ``kinds``,
``per_page``, ``pages`` and ``list`` (the key of the rows in an answer; empty if the answer is the list). Conditions that
pick kinds or set ``date_from`` and ``date_to`` become parameters of the requests; options ``from`` and ``to`` name the latter.

Both take ``cache``, a folder of store_answers() that is asked first, and ``offline`` (true: nothing else is asked).
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections import defaultdict
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from pacegrid.operators.lineage import written

#: Bits of a link's SHA-1 by which a host's links are dealt to tasks where only the cache is asked.
OFFLINE_BITS = 6
#: Bytes of answers that a folder of the cache is planned for, and the least and most bits of a link's SHA-1 that name one.
FOLDER_BYTES, LEAST_BITS, MOST_BITS = 1 << 19, 3, 32
_HEAD = b'{"key":"'
SCHEMA = "url string, status int, html string, error string, attempts int"


def register(spark: SparkSession) -> None:
    """Makes both formats known; conditions reach the services only with Spark's setting for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
    spark.dataSource.register(PagedSource)


def _first_bits(digest: Column, bits: int) -> Column:
    """The first bits of hexadecimal digests, as a text of 0 and 1."""
    return F.substring(F.lpad(F.conv(F.substring(digest, 1, MOST_BITS // 4), 16, 2), MOST_BITS, "0"), 1, bits)


def store_answers(answers: DataFrame, folder: str) -> None:
    """Adds ``answers`` (url, status, text) to a cache folder: the answers of links whose SHA-1s begin alike lie together,
    under so many bits of these that a folder has about FOLDER_BYTES. A file a link takes far longer to commit than to write."""
    line = F.to_json(F.struct(F.sha1(F.col("url").cast("binary")).alias("key"), "status", "text"))
    lines = written(answers.where("url is not null").select(F.sha1(F.col("url").cast("binary")).alias("digest"), line.alias("value")))
    size = lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    bits = min(max((size // FOLDER_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    kept = lines.select(F.lit(bits).alias("bits"), _first_bits(F.col("digest"), bits).alias("key"), "value")
    kept.repartition("key").write.mode("append").partitionBy("bits", "key").text(folder)


class HostPartition(InputPartition):
    """The links of one host, in order."""

    def __init__(self, host: str, urls: list[str]) -> None:
        self.host, self.urls = host, urls


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = list(dict.fromkeys((options.get("urls") or "").split()))
        self.delay, self.timeout = float(options.get("delay", 2.0)), float(options.get("timeout", 25.0))
        self.retries, self.robots = int(options.get("retries", 2)), str(options.get("robots", "true")).lower() == "true"
        self.agent = options.get("agent", "pacegrid/1.0")
        self.cache, self.offline = options.get("cache"), str(options.get("offline", "false")).lower() == "true"
        self.files, self.kept = None, {}

    def partitions(self) -> list[InputPartition]:
        hosts = defaultdict(list)
        for url in self.urls:
            hosts[urlsplit(url).netloc].append(url)
        return [HostPartition(host, urls) for host, urls in sorted(hosts.items())]

    def _folder(self, path: str, place: int) -> tuple[list, dict]:
        """Lines of a folder of the cache with their files' times, in order of these, and the last one by its link; none if there is
        no such folder. Of each ``place`` the last folder asked for is kept."""
        if self.kept.get(place, ("",))[0] != path:
            listed = self.files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
            lines = []
            for x in sorted((x for x in listed if x.base_name.startswith("part-")), key=lambda x: x.mtime_ns):
                with self.files.open_input_stream(x.path) as stream:
                    lines += [(x.mtime_ns, line) for line in stream.read().splitlines()]
            self.kept[place] = path, lines, {line[: len(_HEAD) + 40]: (at, line) for at, line in lines}
        return self.kept[place][1:]

    def _stored(self, url: str) -> tuple[int, str | None, str | None] | None:
        """The cache's answer for a link, the last written one; the folder may be in any store that pyarrow opens."""
        if self.files is None:
            self.files, self.root = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.cache))
            names = [x.base_name for x in self.files.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True))]
            self.bits = sorted(int(x.removeprefix("bits=")) for x in names if x.startswith("bits="))
            self.single = any(x.startswith("key=") for x in names)  # an earlier form: a folder a link
        digest = hashlib.sha1(url.encode()).hexdigest()
        first, head = f"{int(digest[: MOST_BITS // 4], 16):0{MOST_BITS}b}", _HEAD + digest.encode()
        found = [self._folder(f"{self.root}/bits={n}/key={first[:n]}", n)[1].get(head) for n in self.bits]
        if self.single:
            found += self._folder(f"{self.root}/key={digest}", 0)[0][-1:]
        found = [x for x in found if x]
        if not found:
            return None
        answer = json.loads(max(found, key=lambda x: x[0])[1])
        return answer.get("status"), answer.get("text"), None if answer.get("status") == 200 else f"HTTP {answer.get('status')}"

    def _get(self, url: str) -> tuple[int | None, str | None, str | None]:
        stored = self._stored(url) if self.cache else None
        if stored or self.offline:
            return stored or (404, None, "not stored")
        request = urllib.request.Request(url, headers={"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as problem:
            return problem.code, None, f"HTTP {problem.code}"
        except (OSError, ValueError) as problem:
            return None, None, str(problem)

    def _rules(self, url: str) -> urllib.robotparser.RobotFileParser | None:
        """robots.txt of the host; None, which allows everything, if there is none."""
        parts = urlsplit(url)
        status, text, _ = self._get(f"{parts.scheme}://{parts.netloc}/robots.txt")
        if status != 200:
            return None
        rules = urllib.robotparser.RobotFileParser()
        rules.parse((text or "").splitlines())
        return rules

    def open(self, url: str) -> dict:
        """What a host's requests share: its rules, their pause and when the last one was."""
        rules = self._rules(url) if self.robots else None
        return {"rules": rules, "pause": max(self.delay, float((rules and rules.crawl_delay(self.agent)) or 0)), "last": 0.0}

    def fetch(self, url: str, state: dict) -> tuple:
        """(url, status, text, error, attempts); answers of 200 and 4xx are final, others are tried again."""
        if state["rules"] and not state["rules"].can_fetch(self.agent, url):
            return url, None, None, "disallowed by robots.txt", 0
        for attempt in range(self.retries + 1):
            time.sleep(max(0.0, state["last"] + state["pause"] - time.monotonic()))
            state["last"] = time.monotonic()
            status, text, error = self._get(url)
            if status == 200 or (status is not None and 400 <= status < 500):
                break
            if attempt < self.retries:
                time.sleep(1.5 * (attempt + 1))
        return url, status, text, error, attempt + 1

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        state = self.open(partition.urls[0]) if partition.urls else {}
        for url in partition.urls:
            yield self.fetch(url, state)


class PagesSource(DataSource):
    """Registered by ``spark.dataSource.register(PagesSource)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


def fetched(links: DataFrame, options: dict | None = None, tasks: int | None = None) -> DataFrame:
    """(url, status, html, error, attempts) of the distinct ``url`` of ``links``, read by tasks that each own whole hosts.

    A host's links reach one task in order, one after another, so they need no room; nothing passes through the driver. Where
    only the cache is asked (``offline``, no delay), no host has a pace to keep: its links are dealt to tasks by their SHA-1s, and read in their order: the cache's files each come once.
    """
    reader = PagesReader(options or {})
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    owned = links.select("url").where("url is not null").distinct().withColumn("host", host)
    keys, order = ["host"], ["host", "url"]
    if reader.offline and not reader.delay:
        digest = F.sha1(F.col("url").cast("binary"))
        keys, order = ["host", _first_bits(digest, OFFLINE_BITS)], ["host", digest]
    owned = owned.repartition(tasks, *keys) if tasks else owned.repartition(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for owner, url in zip(batch.column("host").to_pylist(), batch.column("url").to_pylist(), strict=True):
                if owner != at:
                    at, state = owner, reader.open(url)
                row = reader.fetch(url, state)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)], ["url", "status", "html", "error", "attempts"])

    return owned.sortWithinPartitions(*order).select("host", "url").mapInArrow(work, SCHEMA)


def not_cached(links: DataFrame, cache: DataFrame) -> DataFrame:
    """``links`` (url) that the page table ``cache`` (key: SHA-1 of the link) lacks."""
    return links.join(cache.select("key"), F.sha1(F.col("url").cast("binary")) == F.col("key"), "left_anti")


def as_cache(pages: DataFrame) -> DataFrame:
    """Rows for the page table: pages that were read, with their key."""
    return pages.where("status = 200").select(F.sha1(F.col("url").cast("binary")).alias("key"), "url", "status", "html", "error")


def date_window(run_day: date, date_from: str | None = None, date_to: str | None = None, days_ahead: int | None = None) -> dict[str, str]:
    """Parameters that narrow a race service's answer: from the given day or the run's, to the given day or so many days on."""
    last = date_to or (run_day + timedelta(days=days_ahead) if days_ahead else None)
    return {"race_event_days_from": str(date_from or run_day)} | ({"race_event_days_to": str(last)} if last else {})


def service_url(base: str, parameters: dict) -> str:
    """``base`` with encoded parameters; ``{kind}`` and ``{page}`` stay to be filled in."""
    return f"{base}?{urlencode(parameters, safe='{}')}"


class PagedReader(DataSourceReader):
    """One partition a kind; its pages are read in turn until one fails, is empty or is short."""

    def __init__(self, options: dict) -> None:
        self.pages, self.url, self.key = PagesReader(options), options["url"], options.get("list", "")
        self.kinds, self.most, self.per_page = (options.get("kinds") or "all").split(), int(options.get("pages", 2)), int(options.get("per_page", 50))
        self.names = {"date_from": options.get("from", "race_event_days_from"), "date_to": options.get("to", "race_event_days_to")}
        self.window: dict[str, date] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Kinds that are asked for narrow the partitions, days of the window become parameters; Spark keeps all other conditions."""
        present = []
        for given in filters:
            column = given.attribute[0] if len(given.attribute) == 1 else None
            equal = isinstance(given, EqualTo | EqualNullSafe) and given.value is not None
            if column == "kind" and (equal or isinstance(given, In)):
                asked = [given.value] if equal else list(given.value)
                self.kinds = [kind for kind in self.kinds if kind in asked]
            elif equal and column in self.names and self.window.get(column, given.value) == given.value:
                self.window[column] = given.value
            elif isinstance(given, IsNotNull):
                present.append((column, given))
            else:
                yield given
        # kinds are never null, nor are the days of a window that was asked for
        yield from (given for column, given in present if column != "kind" and column not in self.window)

    def _link(self, kind: str, page: int) -> str:
        link = self.url.replace("{kind}", kind).replace("{page}", str(page))
        return link + "".join(f"&{self.names[c]}={day}" for c, day in sorted(self.window.items()))

    def partitions(self) -> list[InputPartition]:
        return [HostPartition(kind, [self._link(kind, 1)]) for kind in self.kinds]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        state = self.pages.open(partition.urls[0])
        for place in range(1, self.most + 1):
            url = self._link(partition.host, place)
            _, status, text, error, _ = self.pages.fetch(url, state)
            try:
                found = json.loads(text or "null")
                rows = found.get(self.key) if self.key and isinstance(found, dict) else found
            except ValueError:
                rows = None
            ended = status == 400 and place > 1  # past the last page
            if not ended:
                yield partition.host, self.window.get("date_from"), self.window.get("date_to"), place, url, status, text, error
            if status != 200 or not isinstance(rows, list) or len(rows) < self.per_page:
                return


class PagedSource(DataSource):
    """Registered by register(). A row is an answer: its kind, the window that was asked for (null: none), place, link and text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "kind string, date_from date, date_to date, place int, url string, status int, json string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
